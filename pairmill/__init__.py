"""pairmill: pairwise corpus curation and evaluation as DataFrame transformations."""
