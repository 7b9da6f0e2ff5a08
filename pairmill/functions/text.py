"""Column functions on captions, DOIs, labels and prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names by index, URL prefixes of a DOI, the start of a base64 PNG.
LABELS = ("same_figure", "same_paper", "related_papers", "unrelated_papers")
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi.org/")
PNG_BASE64 = "iVBORw0KGgo"
CAPTION_LIMIT = 2400
RESERVED_TOKENS = ("<|im_start|>", "<|im_end|>", "<|image_pad|>")
# The prompts by pair type, with places for captions and images.
IMAGE = "<image>"
PROMPTS = {
    "cxi": "Caption A: {a}\nQuestion: what is the relation of this figure to the caption?",
    "ixi": f"Figure A:{IMAGE}Figure B:{IMAGE}Are Figure A and Figure B from the same paper, related papers, or unrelated papers?",
    "cxc": "Caption A:\n{a}\n\nCaption B:\n{b}\n\nAre Caption A and Caption B from the same paper, related papers, or unrelated papers?",
}
#: White space as str.strip takes it.
_BLANK = "(?U)[\\s\\x1c-\\x1f]+"


def normalize_caption(text: Column) -> Column:
    """Lower case; every run of Unicode white space is one space; none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), _BLANK, " "))


def normalize_doi(doi: Column, prefixes: tuple[str, ...] = DOI_PREFIXES) -> Column:
    """Lower case without outer white space and without the first URL prefix that fits, in
    the order of `prefixes`; what is left is trimmed again."""
    trimmed = lambda c: F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")
    options = "|".join(p.replace(".", "\\.") for p in prefixes)
    return trimmed(F.regexp_replace(trimmed(F.lower(doi)), f"^({options})", ""))


def journal(doi: Column) -> Column:
    return F.substring_index(doi, "/", 2)


def modality(raw: Column) -> Column:
    return F.when(raw.startswith(PNG_BASE64), "image").otherwise("caption")


def pair_type(first: Column, second: Column) -> Column:
    """First letters of both modalities in order, joined by x: cxc, cxi or ixi."""
    return F.array_join(F.array_sort(F.array(F.substring(first, 1, 1), F.substring(second, 1, 1))), "x")


def truncate_caption(text: Column, limit: int = CAPTION_LIMIT) -> Column:
    return F.substring(text, 1, limit)


def caption_valid(text: Column, reserved: tuple[str, ...] = RESERVED_TOKENS) -> Column:
    """Not blank and free of reserved tokens: those of the tokenizer that is to read it."""
    clean = F.coalesce(normalize_caption(text) != "", F.lit(False))
    for token in filter(None, reserved):
        clean &= ~F.contains(text, F.lit(token))
    return clean


def render_prompt(kind: str, first: Column | None = None, second: Column | None = None, limit: int = CAPTION_LIMIT) -> Column:
    """The prompt of a pair type, captions cut to `limit` characters; IMAGE stands where an
    image goes. Null if a caption that it needs is null."""
    captions = {"{a}": first, "{b}": second}
    parts = [F.substring(captions[p], 1, limit) if p in captions else F.lit(p) for p in re.split(r"(\{[ab]\})", PROMPTS[kind]) if p]
    return F.concat(*parts)


def label_name(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), index.cast("int") + 1)


def label_index(name: Column) -> Column:
    """Null for a name that is no label."""
    at = F.array_position(F.array(*map(F.lit, LABELS)), name).cast("int") - 1
    return F.when(at >= 0, at)
