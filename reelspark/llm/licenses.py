"""License scans by ordered signature rules.

A text becomes its words (ASCII letters lowered, everything but ASCII digits, letters and non-ASCII
characters parts them). A few anchor strings decide whether a text is looked at; a rule's own keyword
then decides whether its regex runs. Some rules are sentences and addresses
that name or imply one license; the others are built from a table of names and a table of forms, in
order of priority. Of two detections, one that lies inside the words of another of the same or a
higher priority is suppressed, so ``lgpl version 3`` does not also give ``gpl``. The base phrases
are matched plainly and always stay.

Defined results: a null or empty text has no words and no labels; repeated rows and ties give equal
values; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reelspark.session import ready

# The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# label, keyword that every match of the name holds, names as regexes over words (SPDX-like short names first), longest names first.
NAMES = (
    ("agpl-3", "agpl", r"agpl(?: ?v?3)?(?: 0)?(?: only| or later)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public license(?: (?:version|v) ?3)?"),
    ("lgpl-3", "lgpl", r"lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"lgpl ?v?2(?: 1)?(?: only| or later)?"),
    ("lgpl", "lgpl", r"lgpl"),
    ("lgpl-3", "general public license", r"(?:gnu )?lesser general public license (?:version|v) ?3"),
    ("lgpl-2.1", "general public license", r"(?:gnu )?(?:lesser|library) general public license (?:version|v) ?2(?: 1)?"),
    ("lgpl", "general public license", r"(?:gnu )?(?:lesser|library) general public license"),
    ("gpl-3", "gpl", r"gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gpl", r"gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "general public license", r"(?:gnu )?general public license (?:version |v)3"),
    ("gpl-2", "general public license", r"(?:gnu )?general public license (?:version |v)2"),
    ("gpl", "general public license", r"(?:gnu )?general public license"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache", "apache", r"apache(?: software)? license"),
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("bsd-2", "bsd", r"(?:simplified |freebsd )?bsd 2(?: clause)?"),
    ("bsd-3", "bsd", r"(?:new |modified |revised )?bsd 3(?: clause)?"),
    ("bsd-4", "bsd", r"(?:original )?bsd 4(?: clause)?"),
    ("bsd-2", "bsd", r"(?:2|two) clause bsd"),
    ("bsd-3", "bsd", r"(?:3|three) clause bsd"),
    ("bsd-4", "bsd", r"(?:4|four) clause bsd"),
    ("bsd-0", "0bsd", r"0bsd"),
    ("bsd", "bsd", r"bsd"),
    ("mpl-2", "mozilla", r"mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version| v)? ?1(?: 1)?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("mpl-2", "mpl", r"mpl ?v?2(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("epl-2", "epl", r"epl ?2(?: 0)?"),
    ("cddl-1", "cddl", r"cddl(?: ?1(?: 0)?)?"),
    ("cddl-1", "common development", r"common development and distribution license"),
    ("eupl-1.2", "eupl", r"eupl(?: ?1 2)?"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e"),
    ("artistic-2", "artistic", r"artistic license(?: version)? ?2(?: 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("bsl-1", "boost", r"boost software license(?: version)?(?: 1(?: 0)?)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2", "python", r"python software foundation license"),
    ("php-3", "php", r"php license"),
    ("ruby", "ruby", r"ruby license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("openssl", "openssl", r"openssl license"),
    ("ofl-1.1", "sil", r"sil open font license"),
    ("ofl-1.1", "ofl", r"ofl ?1 1"),
    ("odbl-1", "odbl", r"odbl(?: 1 0)?"),
    ("odbl-1", "open database", r"open database license"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation license"),
    ("cc-by-nc-nd", "nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "attribution", r"(?:creative commons )?attribution non ?commercial no ?deriv(?:ative ?work|ative)?s?"),
    ("cc-by-nc-sa", "attribution", r"(?:creative commons )?attribution non ?commercial share ?alike"),
    ("cc-by-nc", "attribution", r"(?:creative commons )?attribution non ?commercial"),
    ("cc-by-nd", "attribution", r"(?:creative commons )?attribution no ?deriv(?:ative ?work|ative)?s?"),
    ("cc-by-sa", "attribution", r"(?:creative commons )?attribution share ?alike"),
    ("cc-by", "creative commons", r"creative commons attribution"),
    ("cc", "creative commons", r"creative commons"),
)

# Forms in order of priority: a regex around a name, the confidence of a match, and a word that all its matches hold.
FORMS = (
    (r"spdx license identifier {}", 1.0, "spdx"),
    (r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|redistribute it)(?: [^ ]+)? under (?:the |a |an )?(?:terms of (?:the |version \d of the )?)?{}(?: licen[cs]e)?", 0.95, " under "),
    (r"under (?:the |a |an )?(?:terms (?:and conditions )?of (?:the )?)?{} licen[cs]e", 0.9, " under "),
    (r"(?:the )?{} licen[cs]e", 0.7, "licen"),
    (r"licen[cs]es? (?:is |type )?{}", 0.6, "licen"),
)
#: Texts that speak for a license without naming it, after the forms.
TEXTS = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0.9),
    ("mit", "copies or substantial portions", r"(?:the above copyright notice and )?this permission notice shall be included in all copies or substantial portions", 0.8),
    ("mit", "opensource org", r"opensource org licenses? mit", 0.85),
    ("bsl-1", "accompanying documentation", r"any person or organi[sz]ation obtaining a copy of the software and accompanying documentation", 0.9),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 0.85),
    ("bsd-2", "redistributions of source code", r"redistributions of source code must retain the above copyright notice", 0.7),
    ("bsd-3", "endorse or promote", r"neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products", 0.85),
    ("bsd-3", "opensource org", r"opensource org licenses? bsd 3(?: clause)?", 0.85),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 0.9),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("postgresql", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose", 0.8),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 0.9),
    ("zlib", "express or implied warranty", r"provided as is without any express or implied warranty in no event will the authors be held liable", 0.8),
    ("apache-2", "except in compliance", r"you may not use this (?:file|work) except in compliance with the license", 0.85),
    ("apache-2", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license", 0.85),
    ("apache-2", "apache org", r"apache org licenses(?: license)? 2 0", 0.9),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it", 0.85),
    ("gpl-3", "any later version", r"either version 3 of the license or (?:at your option )?any later version", 0.7),
    ("gpl-2", "any later version", r"either version 2 of the license or (?:at your option )?any later version", 0.7),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it", 0.85),
    ("gpl-3", "gnu org", r"gnu org licenses gpl 3 0", 0.85),
    ("gpl-2", "gnu org", r"gnu org licenses (?:old licenses )?gpl 2 0", 0.85),
    ("lgpl", "gnu org", r"gnu org licenses lgpl", 0.8),
    ("agpl-3", "gnu org", r"gnu org licenses agpl", 0.8),
    ("agpl-3", "remotely through a computer network", r"users interacting with it remotely through a computer network", 0.85),
    ("gfdl", "invariant sections", r"with no invariant sections(?: no front cover texts)?", 0.8),
    ("mpl-2", "source code form", r"this source code form is subject to the terms of the mozilla public license", 0.9),
    ("mpl-2", "mozilla org", r"mozilla org mpl 2 0", 0.85),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms", 0.8),
    ("cddl-1", "common development", r"the contents of this file are subject to the terms of the common development and distribution license", 0.9),
    ("artistic", "same terms as perl", r"under the same terms as perl(?: 5)? itself", 0.85),
    ("python-2", "psf is making", r"psf is making python(?: [0-9 ]+)? available to licensee", 0.9),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project", 0.85),
    ("ofl-1.1", "reserved font name", r"with reserved font names?", 0.8),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain", 0.9),
    ("wtfpl", "what the fuck", r"do what the fuck you want to(?: public license)?", 0.9),
    ("cc0", "copyright and related or neighboring rights", r"waived all copyright and related or neighboring rights", 0.9),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero(?: 1 0)?", 0.9),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd(?: [1-4] [05])?", 0.9),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa(?: [1-4] [05])?", 0.9),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc(?: [1-4] [05])?", 0.9),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd(?: [1-4] [05])?", 0.9),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa(?: [1-4] [05])?", 0.9),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by(?: [1-4] [05])?", 0.9),
    ("odbl-1", "opendatacommons org", r"opendatacommons org licenses odbl", 0.85),
    ("json", "good not evil", r"the software shall be used for good not evil", 0.9),
    ("beerware", "buy me a beer", r"you can buy me a beer(?: in return)?", 0.8),
    ("proprietary", "proprietary information", r"(?:this software|this document|this file) (?:is|contains) (?:the )?confidential and proprietary information", 0.8),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited", 0.8),
    ("non-commercial", "commercial use", r"for (?:personal and )?non ?commercial use only", 0.6),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 0.6),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 0.4),
)
#: Names that speak for themselves without a form around them.
ALONE = re.compile(r"cc |\(\?:creative|creative|\(\?:gnu \)|agpl|lgpl|gpl|apache|0bsd|wtfpl")


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: bytes
    anchor: bytes
    pattern: re.Pattern
    score: float


def rules() -> list[Rule]:
    """All rules, highest priority first."""
    out = []
    for form, score, anchor in FORMS:
        for label, keyword, name in NAMES:
            out.append((label, keyword, anchor, form.replace("{}", f"(?:{name})"), score))
    out += [(label, keyword, keyword, text, score) for label, keyword, text, score in TEXTS]
    for label, keyword, name in NAMES:
        if "licen" in name or ALONE.match(name):
            anchor = "cc by" if name.startswith("cc by") else keyword if ALONE.match(name) else "licen"
            out.append((label, keyword, anchor, name, 0.5))
    return [Rule(k, label, keyword.encode(), anchor.encode(), re.compile(f"(?<= )(?:{text})(?= )".encode()), score) for k, (label, keyword, anchor, text, score) in enumerate(out)]


_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RULES: list[Rule] = []


def anchors(found: list[Rule]) -> list[bytes]:
    """Strings of which one is in every text that a rule or a base phrase can match."""
    wanted = {rule.anchor for rule in found} | {phrase.encode() for phrase, _ in BASE}
    return sorted(x for x in wanted if not any(y in x for y in wanted - {x}))


_ANCHORS: list[bytes] = []


def scan(text: bytes) -> dict:
    """Words, base places and surviving detections (first word, end word, label, score) of one text."""
    if not _RULES:
        _RULES.extend(rules())
        _ANCHORS.extend(anchors(_RULES))
    words = text.translate(_WORDS).split()
    out = {"n_words": len(words), "base": [], "detections": []}
    # The anchors are looked for in the words, however the text parts them.
    joined = b" " + b" ".join(words) + b" "
    if not any(x in joined for x in _ANCHORS):
        return out
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    word = lambda k: int(np.searchsorted(at, k))
    for phrase, label in BASE:
        wanted, k = b" " + phrase.encode() + b" ", -1
        while (k := joined.find(wanted, k + 1)) >= 0:
            out["base"].append((word(k), word(k + len(wanted) - 1), label))
    kept: list[tuple[int, int, str, float]] = []
    reach = np.zeros(len(words), np.int64)  # the furthest end of the kept ones that begin at a word or before
    seen: dict[bytes, bool] = {}
    for rule in _RULES:
        for x in (rule.anchor, rule.keyword):
            if x not in seen:
                seen[x] = x in joined
        if seen[rule.anchor] and seen[rule.keyword]:
            spans = np.array([(m.start() - 1, m.end()) for m in rule.pattern.finditer(joined)], np.int64).reshape(-1, 2)
            spans = np.searchsorted(at, spans)
            spans = spans[reach[spans[:, 0]] < spans[:, 1]]
            if len(spans):
                kept += [(int(a), int(b), rule.label, rule.score) for a, b in spans]
                np.maximum.at(reach, spans[:, 0], spans[:, 1])
                np.maximum.accumulate(reach, out=reach)
    out["detections"] = sorted(kept)
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first:long,end:long,label:string,score:double>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word count, base places, labels, score and detections of every row, as the module says."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                for key, text in zip(part.column(0).to_pylist(), pc.fill_null(part.column(1), "").cast(pa.binary()), strict=True):
                    x = scan(text.as_buffer().to_pybytes())
                    base, found = x["base"], x["detections"]
                    starts = [b[0] for b in base]
                    own = {b[2] for b in base}
                    score = max([0.95 * bool(base), *(d[3] for d in found)])
                    rows.append((key, x["n_words"], len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {d[2] for d in found})), score, [dict(zip(("first", "end", "label", "score"), d, strict=True)) for d in found]))
                long, text = pa.int64(), pa.string()
                kinds = [long, long, long, long, long, text, text, pa.float64(), pa.list_(pa.struct([("first", long), ("end", long), ("label", text), ("score", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, SCHEMA)
