"""Licence recognition by sentence rules, in native expressions only.

A text is cut into sentences at three grains: at full stops and blank lines, with single
line ends folded; then at ';' and ':' too; then at every line end too. Each sentence is
normalised (case, digits, punctuation) and mapped to the identifiers of a known licence
sentence or clause; the coarsest grain that is known counts, and only what it leaves
unknown is looked up at the next. A sentence that names a holder is known by what stands before and
behind the name, and an SPDX tag is a sentence of its own. The sequence of identifiers found in a
document is matched against ordered licence rules, of which an earlier, more specific one wins
over a later one of the same licence. Row-local: one scan, no shuffle.

Defined cases. Null or empty text, and text without a known sentence: empty sequence, no
rule, no licence. A licence stated twice is reported once. Sentences are recognised in
ASCII letters only, since every known sentence is ASCII. Repeated rows are scanned row by row.
No rows: no rows. Very long texts are scanned whole. Other columns, whatever their names,
aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier -> normalised sentence ('#' stands for any number or version).
SENTENCES = {
    "gpl_notice": "this work is licensed under the gnu general public license version #",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version # of the license or at your option any later version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_copy": "you should have received a copy of the gnu general public license along with this program",
    "mit_notice": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_notice": "licensed under the apache license version #",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "bsd_redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
    "cc_by": "licensed under cc by #",
    "cc_by_sa": "licensed under cc by sa #",
    "cc_by_nc": "licensed under cc by nc #",
    "cc_by_nc_sa": "licensed under cc by nc sa #",
    "cc_by_nd": "licensed under cc by nd #",
    "cc_attribution": "this work is licensed under a creative commons attribution # international license",
    "cc_zero": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "lgpl_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version # of the license or at your option any later version",
    "lgpl_warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl_copy": "you should have received a copy of the gnu lesser general public license along with this library",
    "agpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version # of the license or at your option any later version",
    "agpl_copy": "you should have received a copy of the gnu affero general public license along with this program",
    "mpl_notice": "this source code form is subject to the terms of the mozilla public license v",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl #",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense_grant": "this is free and unencumbered software released into the public domain",
    "unlicense_use": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "apache_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "gpl_applies": "this general public license applies to most of the free software foundation s software and to any other program whose authors commit to using it",
    "gpl_copyleft": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl_only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version # as published by the free software foundation",
    "lgpl_only": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license version # as published by the free software foundation",
    "lgpl_adds": "this version of the gnu lesser general public license incorporates the terms and conditions of version # of the gnu general public license supplemented by the additional permissions listed below",
    "lgpl_first": "this is the first released version of the lesser gpl",
    "agpl_copyleft": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "gfdl_purpose": "the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom to assure everyone the effective freedom to copy and redistribute it with or without modifying it either commercially or noncommercially",
    "gfdl_notice": "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version # or any later version published by the free software foundation",
    "artistic_intent": "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package while giving the users of the package the right to use and distribute the package in a more or less customary fashion plus the right to make reasonable modifications",
    "artistic_title": "the artistic license",
    "mpl_code": "covered code means the original code or modifications or the combination of the original code and modifications in each case including portions thereof",
    "mpl_software": "covered software means source code form to which the initial contributor has attached the notice in exhibit a the executable form of such source code form and modifications of such source code form in each case including portions thereof",
    "mpl_title": "mozilla public license version #",
    "apache_terms": "terms and conditions for use reproduction and distribution",
    "apache_meaning": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections # through # of this document",
    "cc_zero_work": "a work made available under cc# may be protected by copyright and related or neighboring rights copyright and related rights",
    "psf_parties": "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation",
    "asf_contributors": "licensed to the apache software foundation asf under one or more contributor license agreements",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
_APACHE = "licensed under the apache license version # the license"
_HOLDERS = ["the copyright holders and contributors", "the copyright holder and contributors", "the regents and contributors", "the author and contributors", "the authors and contributors", "the author", "the authors"]
_NAMED = "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
# Normalised clause as the licence texts have it -> identifiers it states.
CLAUSES = {
    _APACHE: ["apache_notice"],
    f"{_APACHE} you may not use this file except in compliance with the license": ["apache_notice", "apache_use"],
    "you may obtain a copy of the license at http": ["apache_copy"],
    "you may obtain a copy of the license at https": ["apache_copy"],
    SENTENCES["mit_warranty"].replace("noninfringement", "non infringement"): ["mit_warranty"],
    SENTENCES["mpl_notice"] + "#": ["mpl_notice"],
    SENTENCES["mpl_copy"].replace("https", "http"): ["mpl_copy"],
    SENTENCES["bsd_names"].replace("copyright holder", "author"): ["bsd_names"],
    SENTENCES["bsd_names"].replace("copyright holder", "university"): ["bsd_names"],
    **{f"this software is provided by {h} as is {_NAMED}": ["bsd_warranty"] for h in _HOLDERS},
    **{f"this software is provided by {h} as is and any express or implied warranties are disclaimed": ["bsd_warranty"] for h in _HOLDERS[1:]},
}
# Words before and behind a variable part -> identifier.
GAPS = [
    ("neither the name of ", " may be used to endorse or promote products derived from this software without specific prior written permission", "bsd_names"),
    ("neither the names of ", " may be used to endorse or promote products derived from this software without specific prior written permission", "bsd_names"),
    ("this software is provided by ", f" as is {_NAMED}", "bsd_warranty"),
    ("this software is provided by ", " as is and any express or implied warranties are disclaimed", "bsd_warranty"),
]
# SPDX names -> licence.
SPDX = {"mit": "MIT", "apache #": "Apache", "bsd # clause": "BSD", "isc": "ISC", "unlicense": "Unlicense", "mpl #": "MPL", "cc# #": "CC0", "psf #": "PSF", "python #": "PSF", "artistic #": "Artistic"}
SPDX |= {f"{x} #{end}": x.upper() for x in ("gpl", "lgpl", "agpl", "gfdl") for end in ("", " only", " or later")}
SPDX |= {f"cc by{x} #": f"CC-BY{x.replace(' ', '-').upper()}" for x in ("", " sa", " nc", " nd", " nc sa", " nc nd")}
CLAUSES |= {
    **{f"spdx license {x}": [f"spdx_{x.replace(' ', '_').replace('#', 'n')}"] for x in SPDX},
    **{f"gnu general public license version # {x}": ["gpl_title"] for x in ("june #", "february #", "# june #")},
    **{f"gnu lesser general public license version # {x}": ["lgpl_title"] for x in ("february #", "# june #")},
    "gnu library general public license version # june #": ["lgpl_title"],
    "this is the first released version of the library gpl": ["lgpl_first"],
    "the general public license applies to the free software foundation s software and to any other program whose authors commit to using it": ["gpl_applies"],
    **{f"gnu free documentation license version # {x}": ["gfdl_title"] for x in ("march #", "november #", "# november #")},
    "the asf licenses this file to you under the apache license version # the license": ["apache_notice"],
    "the asf licenses this file to you under the apache license version # the license you may not use this file except in compliance with the license": ["apache_notice", "apache_use"],
    "this program is free software you can redistribute it and or modify it under the terms of version # of the gnu general public license as published by the free software foundation": ["gpl_only"],
    "this library is free software you can redistribute it and or modify it under the terms of version # of the gnu lesser general public license as published by the free software foundation": ["lgpl_only"],
}
# Ordered rules (rule, licence, identifier sequence in order of appearance).
RULES = [
    ("gpl_full", "GPL", ["gpl_free", "gpl_warranty", "gpl_copy"]),
    ("mit_full", "MIT", ["mit_grant", "mit_condition", "mit_warranty"]),
    ("apache_full", "Apache", ["apache_notice", "apache_use", "apache_copy"]),
    ("bsd_three", "BSD", ["bsd_redist", "bsd_names", "bsd_warranty"]),
    ("bsd_full", "BSD", ["bsd_redist", "bsd_warranty"]),
    ("lgpl_full", "LGPL", ["lgpl_free", "lgpl_warranty", "lgpl_copy"]),
    ("agpl_full", "AGPL", ["agpl_free", "gpl_warranty", "agpl_copy"]),
    ("mpl_full", "MPL", ["mpl_notice", "mpl_copy"]),
    ("isc_full", "ISC", ["isc_grant", "isc_warranty"]),
    ("unlicense_full", "Unlicense", ["unlicense_grant", "unlicense_use"]),
    ("asf_header", "Apache", ["asf_contributors", "apache_notice"]),
    ("gpl_only_full", "GPL", ["gpl_only", "gpl_warranty"]),
    ("lgpl_only_full", "LGPL", ["lgpl_only", "lgpl_warranty"]),
    ("gpl_text", "GPL", ["gpl_title", "gpl_applies"]),
    ("gpl_three", "GPL", ["gpl_title", "gpl_copyleft"]),
    ("lgpl_text", "LGPL", ["lgpl_title", "lgpl_first"]),
    ("lgpl_three", "LGPL", ["lgpl_title", "lgpl_adds"]),
    ("agpl_text", "AGPL", ["agpl_copyleft"]),
    ("gfdl_text", "GFDL", ["gfdl_title", "gfdl_purpose"]),
    ("artistic_text", "Artistic", ["artistic_title", "artistic_intent"]),
    ("mpl_one", "MPL", ["mpl_title", "mpl_code"]),
    ("mpl_two", "MPL", ["mpl_title", "mpl_software"]),
    ("apache_text", "Apache", ["apache_terms", "apache_meaning"]),
    ("psf_text", "PSF", ["psf_parties"]),
    ("cc_zero_text", "CC0", ["cc_zero_work"]),
    ("gfdl_grant", "GFDL", ["gfdl_notice"]),
    ("gpl_only_grant", "GPL", ["gpl_only"]),
    ("lgpl_only_grant", "LGPL", ["lgpl_only"]),
    ("gpl_grant", "GPL", ["gpl_free"]),
    ("gpl_short", "GPL", ["gpl_notice"]),
    ("lgpl_grant", "LGPL", ["lgpl_free"]),
    ("agpl_grant", "AGPL", ["agpl_free"]),
    ("mpl_short", "MPL", ["mpl_notice"]),
    ("isc_text", "ISC", ["isc_grant"]),
    ("unlicense_short", "Unlicense", ["unlicense_grant"]),
    ("mit_text", "MIT", ["mit_grant"]),
    ("mit_short", "MIT", ["mit_notice"]),
    ("mit_reference", "MIT", ["mit_licensed"]),
    ("apache_short", "Apache", ["apache_notice"]),
    ("bsd_text", "BSD", ["bsd_redist"]),
    ("cc_by_nc_sa", "CC-BY-NC-SA", ["cc_by_nc_sa"]),
    ("cc_by_nc", "CC-BY-NC", ["cc_by_nc"]),
    ("cc_by_nd", "CC-BY-ND", ["cc_by_nd"]),
    ("cc_by_sa", "CC-BY-SA", ["cc_by_sa"]),
    ("cc_by", "CC-BY", ["cc_by"]),
    ("cc_attribution", "CC-BY", ["cc_attribution"]),
    ("cc_zero", "CC0", ["cc_zero"]),
    *[(CLAUSES[f"spdx license {x}"][0], name, CLAUSES[f"spdx license {x}"]) for x, name in SPDX.items()],
]
#: Every known sentence holds one of these, so a text without them holds no known sentence.
TRIGGER = "(?i)licen[sc]e|permi(t|ssion)|warrant|copyright|unencumbered|free to copy|mpl was|first released version|terms and conditions|covered (code|software) means"
NUMBER = "[0-9]+([.][0-9]+)*"
SENTENCE_END = "[.!?;:\\n\\r]+"
NOT_PLAIN = "[^a-z0-9#]+"
#: A tag in a file's head, and the sentence made of it.
SPDX_TAG, SPDX_SAYS = "spdx-license-identifier:[ \\t]*([a-z0-9.+-]+)", (". spdx license ", " . ")
#: Signs of a comment before each line, before numbers become '#'.
COMMENT = "^[ \\t]*(//+|/?[*]+|#+|;+|%+|--|>+)[ \\t]+|^[ \\t]*(//+|/?[*]+/?|#+|;+|%+|--|>+)[ \\t\\r]*$"
#: Lines end at line feeds only: the flags that say so in Java and elsewhere.
LINES_JAVA, LINES = "(?md)", "(?m)"
#: Full stops before white space, and blank lines; signs that end a sentence within a line.
COARSE_END = "[.!?]+([ \\t-\\r]|$)|\\r?\\n[ \\t\\r]*\\n"
CLAUSE_END = "[.!?;:]+"


def rule_pattern(sequence: list[str]) -> str:
    """The sequence, in order, with other identifiers allowed between its members."""
    return "(^| )" + "( | .* )".join(sequence) + "( |$)"


def _plain(part: Column) -> Column:
    return F.trim(F.regexp_replace(part, NOT_PLAIN, " "))


def sentence_ids(text: Column) -> Column:
    """Array of the identifiers of known sentences, in order of appearance."""
    whole = {**{v: [k] for k, v in SENTENCES.items()}, **CLAUSES}
    known = F.create_map(*[x for v, ids in whole.items() for x in (F.lit(v), F.array(*map(F.lit, ids)))])
    none = F.array().cast("array<string>")

    def named(part: Column) -> Column:
        gaps = [F.when(F.startswith(part, F.lit(a)) & F.endswith(part, F.lit(b)) & (F.length(part) > len(a) + len(b)), F.array(F.lit(k))) for a, b, k in GAPS]
        return F.coalesce(F.try_element_at(known, part), *gaps)

    def cascade(part: Column, ends: list[str]) -> Column:
        """Identifiers of the part if it is known, or else of its pieces."""
        own = F.transform(F.array(_plain(part)), named)[0]
        if not ends:
            return F.coalesce(own, none)
        pieces = F.flatten(F.transform(F.split(part, ends[0]), lambda s: cascade(s, ends[1:])))
        return F.coalesce(own, pieces)

    tagged = F.regexp_replace(F.regexp_replace(F.lower(text), LINES_JAVA + COMMENT, ""), SPDX_TAG, SPDX_SAYS[0] + "$1" + SPDX_SAYS[1])
    numbered = F.regexp_replace(tagged, NUMBER, "#")
    found = F.flatten(F.transform(F.split(numbered, COARSE_END), lambda s: cascade(s, [CLAUSE_END, SENTENCE_END])))
    return F.when(text.rlike(TRIGGER), found).otherwise(none)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: sentence_ids (space-joined), n_sentences, rules (of each
    licence the first that matches, in rule order) and licenses (in the same order)."""
    seq = F.col("seq")
    found = [F.when(seq.rlike(rule_pattern(ids)), F.struct(F.lit(r).alias("rule"), F.lit(lic).alias("license"))) for r, lic, ids in RULES]
    matched = F.filter(F.array(*found), lambda x: x.isNotNull())
    first = lambda m: F.filter(m, lambda x, i: (i == 0) | ~F.exists(F.slice(m, 1, i), lambda y: y["license"] == x["license"]))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.array_join(F.coalesce(sentence_ids(F.col(text_col)), F.array().cast("array<string>")), " ").alias("seq"))
        .select("doc_id", "seq", F.when(seq != "", F.transform(F.array(matched), first)[0]).otherwise(F.filter(F.array(*found[:1]), lambda x: F.lit(False))).alias("m"))
        .select(
            "doc_id",
            F.col("seq").alias("sentence_ids"),
            F.when(seq == "", F.lit(0)).otherwise(F.size(F.split("seq", " "))).cast("long").alias("n_sentences"),
            F.array_join(F.transform("m", lambda x: x["rule"]), " ").alias("rules"),
            F.array_join(F.transform("m", lambda x: x["license"]), " ").alias("licenses"),
        )
    )
