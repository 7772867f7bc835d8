"""License scans by ordered signature rules.

A text becomes its lower-case words parted by single spaces. Hundreds of regexes are tried on that, each only if one of its keywords occurs: one pass of an Aho-Corasick automaton over the text finds the keywords. What matches is a detection: a run of words with the rule's label, priority and confidence. Detections are resolved in the
order of priority, then length, then place: one that lies inside a detection already kept, or holds the same words, is suppressed. The base phrases are rules too; their places are all reported, and resolving never removes their labels.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table, thrifty

#: Fixed by the contract: phrase, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Bytes that part words become spaces; A to Z become a to z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Families: label, SPDX identifier in words, path of its web page in words, how texts name it (regex), and further regexes of notices or of the licence's own text. An empty field has no rule.
FAMILIES = """
apache-2.0 ~ apache 2 0 ~ apache org licenses license 2 0 ~ apache (?:software )?licen[sc]e(?: version)? 2(?: 0)? ~ you may not use this file except in compliance with the license ; unless required by applicable law or agreed to in writing software distributed under the license ; apache 2 0 licensed? ; asl 2 0
apache-1.1 ~ apache 1 1 ~ apache org licenses license 1 1 ~ apache (?:software )?licen[sc]e(?: version)? 1 1 ~ this product includes software developed by the apache software foundation
apache-1.0 ~ apache 1 0 ~ apache org licenses license 1 0 ~ apache (?:software )?licen[sc]e(?: version)? 1 0 ~ this product includes software developed by the apache group
mit ~ mit ~ opensource org licenses mit(?: license)?(?: php)? ~ mit (?:x11 )?licen[sc]ed? ~ permission is hereby granted free of charge to any person obtaining a copy ; the software is provided as is without warranty of any kind express or implied ; mit style licen[sc]e ; the above copyright notice and this permission notice shall be included
mit-0 ~ mit 0 ~ opensource org licenses mit 0 ~ mit no attribution(?: licen[sc]e)? ~
x11 ~ x11 ~ ~ x11 licen[sc]e ~ except as contained in this notice the name of the x consortium shall not be used
isc ~ isc ~ opensource org licenses isc ~ isc licen[sc]e ~ permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd ~ 0bsd ~ opensource org licenses 0bsd ~ (?:zero clause bsd|bsd zero clause|0 ?bsd) licen[sc]e ~
bsd-2-clause ~ bsd 2 clause ~ opensource org licenses bsd 2 clause ~ (?:simplified|2 clause|two clause|freebsd) bsd(?: style)? licen[sc]e ; bsd (?:2|two) clause ~
bsd-3-clause ~ bsd 3 clause ~ opensource org licenses bsd 3 clause ~ (?:new|modified|revised|3 clause|three clause) bsd(?: style)? licen[sc]e ; bsd (?:3|three) clause ~ neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used
bsd-4-clause ~ bsd 4 clause ~ ~ (?:original|4 clause|four clause) bsd licen[sc]e ~ all advertising materials mentioning features or use of this software must display
bsd ~ bsd ~ opensource org licenses bsd license ~ bsd(?: style)? licen[sc]ed? ~ redistribution and use in source and binary forms with or without modification are permitted ; redistributions of source code must retain the above copyright notice
gpl-1.0 ~ gpl 1 0(?: only| or later)? ~ gnu org licenses(?: old licenses)? gpl 1 0 ~ (?:gnu )?(?:gpl|general public licen[sc]e)(?: gpl)?(?: version| v)? ?1(?: 0)? ~
gpl-2.0 ~ gpl 2 0(?: only| or later)? ~ gnu org licenses(?: old licenses)? gpl 2 0 ~ (?:gnu )?(?:gpl|general public licen[sc]e)(?: gpl)?(?: version| v)? ?2(?: 0)?(?: or (?:any )?later)? ; gplv2 ~ published by the free software foundation (?:either )?version 2
gpl-3.0 ~ gpl 3 0(?: only| or later)? ~ gnu org licenses gpl 3 0 ~ (?:gnu )?(?:gpl|general public licen[sc]e)(?: gpl)?(?: version| v)? ?3(?: 0)?(?: or (?:any )?later)? ; gplv3 ~ published by the free software foundation (?:either )?version 3
gpl-any ~ gpl ~ gnu org (?:licenses gpl|copyleft gpl) ~ gnu gpl ; gnu general public licen[sc]e ~ this program is free software you can redistribute it and or modify it ; you should have received a copy of the gnu general public license
lgpl-2.0 ~ lgpl 2 0(?: only| or later)? ~ gnu org licenses(?: old licenses)? lgpl 2 0 ~ (?:gnu )?(?:lgpl|library general public licen[sc]e)(?: version| v)? ?2(?: 0)? ~
lgpl-2.1 ~ lgpl 2 1(?: only| or later)? ~ gnu org licenses(?: old licenses)? lgpl 2 1 ~ (?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version| v)? ?2 1 ; lgplv2 1 ~
lgpl-3.0 ~ lgpl 3 0(?: only| or later)? ~ gnu org licenses lgpl 3 0 ~ (?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version| v)? ?3(?: 0)? ; lgplv3 ~
lgpl-any ~ lgpl ~ gnu org (?:licenses|copyleft) (?:lgpl|lesser) ~ gnu (?:lgpl|(?:lesser|library) general public licen[sc]e) ~ you should have received a copy of the gnu (?:lesser|library) general public license
agpl-3.0 ~ agpl 3 0(?: only| or later)? ~ gnu org licenses agpl 3 0 ~ (?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version| v)? ?3(?: 0)? ; agplv3 ~ gnu affero general public licen[sc]e
gfdl ~ gfdl 1 [123](?: only| or later)? ~ gnu org licenses fdl ~ gnu free documentation licen[sc]e ~ permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-1.1 ~ mpl 1 1 ~ mozilla org mpl (?:mpl )?1 1 ~ mozilla public licen[sc]e(?: version| v)? ?1 1 ~ the contents of this file are subject to the mozilla public license
mpl-2.0 ~ mpl 2 0 ~ mozilla org (?:en us )?mpl 2 0 ~ mozilla public licen[sc]e(?: version| v)? ?2(?: 0)? ; mpl ?v?2 0 ~ this source code form is subject to the terms of the mozilla public license
epl-1.0 ~ epl 1 0 ~ eclipse org (?:legal )?epl v10 ~ eclipse public licen[sc]e(?: version| v)? ?1(?: 0)? ~
epl-2.0 ~ epl 2 0 ~ eclipse org (?:legal )?epl (?:v20|2 0) ~ eclipse public licen[sc]e(?: version| v)? ?2(?: 0)? ~ this program and the accompanying materials are made available under the terms of the eclipse public license
cpl-1.0 ~ cpl 1 0 ~ opensource org licenses cpl1 0 ~ common public licen[sc]e(?: version| v)? ?1(?: 0)? ~
cddl-1.0 ~ cddl 1 0 ~ opensource org licenses cddl 1 0? ~ common development and distribution licen[sc]e(?: cddl)?(?: version| v)?(?: ?1(?: 0)?)? ~
eupl ~ eupl 1 [12] ~ ~ european union public licen[sc]e ~ licensed under the eupl
artistic-2.0 ~ artistic 2 0 ~ opensource org licenses artistic license 2 0 ~ artistic licen[sc]e(?: version| v)? ?2(?: 0)? ~
artistic ~ artistic 1 0 ~ ~ artistic licen[sc]e ~ under the same terms as perl itself
bsl-1.0 ~ bsl 1 0 ~ boost org license 1 0(?: txt)? ~ boost software licen[sc]e(?: version 1 0)? ~ permission is hereby granted free of charge to any person or organization obtaining a copy
busl-1.1 ~ busl 1 1 ~ ~ business source licen[sc]e(?: version)?(?: 1 1)? ~ the licensor may make an additional use grant
sspl-1.0 ~ sspl 1 0 ~ mongodb com licensing server side public license ~ server side public licen[sc]e ~
elastic-2.0 ~ elastic 2 0 ~ elastic co licensing elastic license ~ elastic licen[sc]e(?: 2 0)? ~
unlicense ~ unlicense ~ unlicense org ~ the unlicense ~ this is free and unencumbered software released into the public domain
wtfpl ~ wtfpl ~ wtfpl net ~ do what the fuck you want to public licen[sc]e ~
zlib ~ zlib ~ zlib net zlib license ~ zlib(?: libpng)? licen[sc]e ~ altered source versions must be plainly marked as such
psf-2.0 ~ (?:psf|python) 2 0 ~ docs python org license ~ python software foundation licen[sc]e ~
ofl-1.1 ~ ofl 1 1 ~ scripts sil org ofl ~ sil open font licen[sc]e(?: version 1 1)? ~ with reserved font name
ms-pl ~ ms pl ~ opensource org licenses ms pl ~ microsoft public licen[sc]e ~
ms-rl ~ ms rl ~ opensource org licenses ms rl ~ microsoft reciprocal licen[sc]e ~
openssl ~ openssl ~ openssl org source license ~ openssl licen[sc]e ~ this product includes software developed by the openssl project
odbl-1.0 ~ odbl 1 0 ~ opendatacommons org licenses odbl ~ open (?:data commons open )?database licen[sc]e ~ made available under the open database license
odc-by ~ odc by 1 0 ~ opendatacommons org licenses by ~ open data commons attribution licen[sc]e ~
pddl ~ pddl 1 0 ~ opendatacommons org licenses pddl ~ public domain dedication and licen[sc]e ~
openrail ~ ~ ~ (?:bigscience |bigcode |creativeml )?open ?rail(?: m)?(?: licen[sc]e)? ~ use based restrictions as referenced in
llama ~ ~ ~ llama (?:[23] )?community licen[sc]e ~
cc0-1.0 ~ cc0 1 0 ~ creativecommons org publicdomain zero 1 0 ~ (?:creative commons )?cc0(?: 1 0)?(?: universal)? ; creative commons zero ~ to the extent possible under law .{1,80} has waived all copyright
cc-by-3.0 ~ cc by 3 0 ~ creativecommons org licenses by 3 0 ~ (?:creative commons attribution|cc by) 3 0(?: unported)? ~
cc-by-4.0 ~ cc by 4 0 ~ creativecommons org licenses by 4 0 ~ (?:creative commons attribution|cc by) 4 0(?: international)? ~
cc-by-sa-3.0 ~ cc by sa 3 0 ~ creativecommons org licenses by sa 3 0 ~ (?:creative commons attribution share ?alike|cc by sa) 3 0 ~
cc-by-sa-4.0 ~ cc by sa 4 0 ~ creativecommons org licenses by sa 4 0 ~ (?:creative commons attribution share ?alike|cc by sa) 4 0 ~
cc-by-nc-3.0 ~ cc by nc 3 0 ~ creativecommons org licenses by nc 3 0 ~ (?:creative commons attribution non ?commercial|cc by nc) 3 0 ~
cc-by-nc-4.0 ~ cc by nc 4 0 ~ creativecommons org licenses by nc 4 0 ~ (?:creative commons attribution non ?commercial|cc by nc) 4 0 ~
cc-by-nd-4.0 ~ cc by nd 4 0 ~ creativecommons org licenses by nd 4 0 ~ (?:creative commons attribution no ?deriv(?:ative)?s|cc by nd) 4 0 ~
cc-by-nc-sa-4.0 ~ cc by nc sa 4 0 ~ creativecommons org licenses by nc sa 4 0 ~ (?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 4 0 ~
cc-by-nc-nd-4.0 ~ cc by nc nd 4 0 ~ creativecommons org licenses by nc nd 4 0 ~ (?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd) 4 0 ~
cc-by-sa ~ ~ creativecommons org licenses by sa ~ cc by sa ; creative commons attribution share ?alike ~
cc-by-nc ~ ~ creativecommons org licenses by nc ~ cc by nc ; creative commons attribution non ?commercial ~
cc-by-nd ~ ~ creativecommons org licenses by nd ~ cc by nd ; creative commons attribution no ?deriv(?:ative)?s ~
cc-by-nc-sa ~ ~ creativecommons org licenses by nc sa ~ cc by nc sa ~
cc-by-nc-nd ~ ~ creativecommons org licenses by nc nd ~ cc by nc nd ~
cc-any ~ ~ creativecommons org licenses ~ creative commons(?: attribution)?(?: licen[sc]e)? ~ some rights reserved
public-domain ~ ~ ~ public domain ~ (?:released|placed|dedicated) (?:in)?to the public domain ; this work is in the public domain ; no copyright reserved
proprietary ~ ~ ~ proprietary and confidential ; commercial licen[sc]e ~ unauthorized (?:copying|reproduction|use|distribution) (?:of this [^ ]+ )?(?:via any medium )?is (?:strictly )?prohibited ; all rights reserved worldwide ; may not be (?:copied|reproduced|redistributed|published) ; for internal use only ; do not (?:copy|distribute)
copyright ~ ~ ~ copyright(?: c| ©)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])? ~ copyrighted material ; the copyright holders?
non-commercial ~ ~ ~ non commercial (?:use|purposes)(?: only)? ~ for (?:personal|educational|research|academic) (?:use|purposes) only ; not for (?:commercial use|resale)
licensed-unknown ~ ~ ~ licensed under(?: the)?(?: terms of)?(?: the)? [^ ]+ ~ this work is licensed under ; released under (?:the )?[^ ]+ licen[sc]e ; see (?:the )?(?:file )?licen[sc]e(?: txt| md)? for (?:details|more information)
"""


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern
    base: bool = False


def _keyword(pattern: str) -> str:
    """The longest literal run that every match of the pattern must hold."""
    plain, depth, runs, run = pattern, 0, [], ""
    i = 0
    while i < len(plain):
        c = plain[i]
        if c == "(":
            depth += 1
        elif c == "[" and depth == 0:
            runs.append(run)
            run = ""
            i = plain.index("]", i)
        elif c == ")":
            depth -= 1
            if depth == 0:
                runs.append(run)
                run = ""
        elif depth == 0 and (c.isalnum() and c.isascii() or c == " "):
            run += c
        elif depth == 0:
            runs.append(run[:-1] if c in "?*{" else run)
            run = ""
            if c == "{":
                i = plain.index("}", i)
        i += 1
    runs.append(run)
    if "|" in re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", "", pattern):
        return ""
    return max((r.strip() for r in runs), key=len)


#: Keywords of patterns that start with alternatives: where the first is in the pattern, each match holds one of them.
_STEMS = (("cc0",), ("gpl", "general public licen"), ("creative commons", "cc by"), ("bsd",), ("licen",), ("rail",))


def _keywords(pattern: str) -> tuple[str, ...]:
    literal = _keyword(pattern)
    return (literal,) if len(literal) >= 4 else next((stems for stems in _STEMS if stems[0] in pattern), (literal,))


def _rule(number: int, label: str, priority: int, confidence: float, pattern: str, base: bool = False) -> Rule:
    coded = pattern.encode().decode("latin-1")  # texts are matched byte by byte
    return Rule(number, label, priority, confidence, _keywords(coded), re.compile(f"(?<![^ ])(?:{coded})(?![^ ])"), base)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order: licence identifiers, web pages, names, notices, base phrases; the more a rule says the earlier it stands."""
    out: list[Rule] = []
    add = lambda *a, **b: out.append(_rule(len(out), *a, **b))
    for phrase, label in BASE:
        add(label, 10, 0.5, phrase, base=True)
    for line in FAMILIES.strip().splitlines():
        label, spdx, page, names, notices = (x.strip() for x in line.split("~"))
        vague = label in ("licensed-unknown", "copyright", "cc-any", "gpl-any", "lgpl-any", "bsd", "proprietary", "non-commercial", "public-domain", "artistic")
        if spdx:
            add(label, 60, 1.0, f"spdx license identifier {spdx}")
            add(label, 55, 0.95, f"licen[sc]e {spdx}")
        if page:
            add(label, 50, 0.95, page)
        for name in filter(None, (x.strip() for x in names.split(" ; "))):
            add(label, 20 if vague else 40, 0.6 if vague else 0.9, name)
            if not vague:
                add(label, 45, 0.95, f"(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:{name})")
        for notice in filter(None, (x.strip() for x in notices.split(" ; "))):
            add(label, 15 if vague else 35, 0.55 if vague else 0.85, notice)
    return tuple(out)


@cache
def _automaton():
    import ahocorasick

    found, by_keyword = ahocorasick.Automaton(), {}
    for r in rules():
        for k in r.keywords:
            by_keyword.setdefault(k, []).append(r)
    for k, v in by_keyword.items():
        found.add_word(k, tuple(v))
    found.make_automaton()
    return found


@dataclass(frozen=True)
class Detection:
    label: str
    first: int
    last: int
    priority: int
    confidence: float
    rule: int


def words_of(text: bytes) -> bytes:
    """The text's lower-case words, parted by single spaces."""
    return b" ".join(text.translate(_FOLD).split())


def detect(words: bytes) -> tuple[list[tuple[int, str]], list[Detection]]:
    """The base phrases' places (word, label), and all detections, from words_of()."""
    text = words.decode("latin-1")
    gated = {r for _, rs in _automaton().iter(text) for r in rs}
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32) if gated else None
    base, found = [], []
    for r in sorted(gated, key=lambda r: r.number):
        for m in r.pattern.finditer(text):
            first, last = np.searchsorted(spaces, m.span()).tolist()  # spaces before the match and up to its end
            if r.base:
                base.append((first, r.label))
            found.append(Detection(r.label, first, last, r.priority, r.confidence, r.number))
    return base, found


def resolve(found: list[Detection]) -> list[Detection]:
    """Keeps detections in the order of priority, length and place; one inside a kept one is suppressed. `firsts` and `lasts` are the kept intervals that are in no other: both rise, so the last one that starts early enough decides."""
    kept: list[Detection] = []
    firsts: list[int] = []
    lasts: list[int] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.first - d.last, d.first, d.rule)):
        at = bisect_right(firsts, d.first)
        if at and lasts[at - 1] >= d.last:
            continue
        kept.append(d)
        lo = at - 1 if at and firsts[at - 1] == d.first else at
        hi = bisect_right(lasts, d.last, lo)
        firsts[lo:hi], lasts[lo:hi] = [d.first], [d.last]
    return kept


def scan_text(text: bytes) -> dict:
    words = words_of(text)
    base, found = detect(words)
    kept = resolve(found)
    doubt = 1.0
    best: dict[str, float] = {}
    for d in kept:
        best[d.label] = max(best.get(d.label, 0.0), d.confidence)
    for _, c in sorted(best.items()):
        doubt *= 1 - c
    base_labels = sorted({x for _, x in base})
    return {
        "n_words": words.count(b" ") + 1 if words else 0, "n_base": len(base), "first_word": min((w for w, _ in base), default=None), "last_word": max((w for w, _ in base), default=None), "base_labels": ",".join(base_labels),
        "labels": ",".join(sorted({*base_labels, *best})), "score": round(1 - doubt, 9), "spans": [{"label": d.label, "first_word": d.first, "last_word": d.last, "rule": d.rule} for d in sorted(kept, key=lambda d: (d.first, d.last, d.rule))],
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,rule:int>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA of each row: the words, the base phrases' places, all labels, a score from 0 to 1 and the kept detections.

    A null text is empty: no words, no labels, score 0. Repeated rows stay; an empty table gives no rows; other columns of df are not read. Texts of any length are taken whole.
    """
    bounded_batches(df.sparkSession)
    kinds = {"first_word": pa.int64(), "last_word": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "score": pa.float64(), "base_labels": pa.string(), "labels": pa.string()}
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("rule", pa.int32())]))

    def run(batches):
        for batch in batches:
            got = [scan_text(x.as_py()) for x in batch.column(1).cast(pa.binary())]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[n] for x in got], kinds[n]) for n in names], pa.array([x["spans"] for x in got], span)], names=["doc_id", *names, "spans"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long"), text).mapInArrow(thrifty(run), SCHEMA)


def op1_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("spans")
