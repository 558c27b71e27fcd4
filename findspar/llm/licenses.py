"""License scan: ordered signature rules behind a keyword prefilter.

Two layers.  The base layer finds three fixed phrases by their words.  The method
layer is an ordered list of signature regexes: sentences of license texts and notices,
written one by one, and titles, notices, addresses and identifiers, which families,
versions and wordings expand to some hundreds.  A rule runs on a text only if, of each of
its keyword groups, the lower-cased text contains one, which every match of its regex
does (as parts of words too: "“MIT", "FreeBSD", "©2019"), so that most regexes don't
run.  Every match is an interval; matches are taken in order of priority, then length, then
position, and a match inside an interval that is already taken is suppressed, so
"GNU Lesser General Public License v3" doesn't count as a plain mention of the GPL
too.  Labels of the base layer always stay.

No shuffle: each text is scanned where it is read.  Defined results: a null text
is an empty one: no words, no labels (an empty string), score 0, null positions.
Repeated rows repeat their result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from findspar.llm import _words as w
from findspar.llm._frames import add_struct, fresh, narrow

FIELDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,rule:int,start:bigint,end:bigint>>"

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Share of certainty that a detection of a kind, or a base phrase, brings.
CERTAINTY = {"spdx": 0.95, "url": 0.9, "notice": 0.9, "title": 0.8, "mention": 0.6, "base": 0.5}
PRIORITY = {kind: i for i, kind in enumerate(("spdx", "url", "notice", "title", "mention"))}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keywords: tuple[frozenset[str], ...]  # of each group one must be there
    regex: re.Pattern


# Fixed values: (label, SPDX stem, name as a regex, the strings it needs, versions, address as a regex).
FAMILIES = (
    ("agpl", "agpl", r"(?:gnu )?affero general public licen[sc]e", "affero public", ("1.0", "3.0"), r"gnu\.org/licenses/agpl"),
    ("lgpl", "lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public", ("2.0", "2.1", "3.0"), r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("gpl", "gpl", r"(?:gnu )?general public licen[sc]e", "general public", ("1.0", "2.0", "3.0"), r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("gfdl", "gfdl", r"(?:gnu )?free documentation licen[sc]e", "free documentation", ("1.1", "1.2", "1.3"), r"gnu\.org/licenses/(?:old-licenses/)?fdl"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", "apache", ("1.0", "1.1", "2.0"), r"apache\.org/licenses"),
    ("mit", "mit", r"(?:mit|expat) licen[sc]e", "mit|expat licen", (), r"opensource\.org/licenses/mit"),
    ("bsd-2-clause", "bsd-2-clause", r"(?:bsd 2[- ]clause|simplified bsd|freebsd) licen[sc]e", "bsd licen", (), r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd-3-clause", r"(?:bsd 3[- ]clause|new bsd|modified bsd) licen[sc]e", "bsd licen", (), r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd-4-clause", r"(?:bsd 4[- ]clause|original bsd) licen[sc]e", "bsd licen", (), r"spdx\.org/licenses/bsd-4-clause"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[sc]e", "bsd licen", (), r"opensource\.org/licenses/bsd"),
    ("mpl", "mpl", r"mozilla public licen[sc]e", "mozilla", ("1.0", "1.1", "2.0"), r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", "epl", r"eclipse public licen[sc]e", "eclipse", ("1.0", "2.0"), r"eclipse\.org/legal/epl"),
    ("eupl", "eupl", r"european union public licen[sc]e", "european public", ("1.0", "1.1", "1.2"), r"(?:joinup\.ec\.)?europa\.eu/[\w/-]*eupl"),
    ("cddl", "cddl", r"common development and distribution licen[sc]e", "development distribution", ("1.0", "1.1"), r"opensource\.org/licenses/cddl"),
    ("cpl", "cpl", r"common public licen[sc]e", "common public", ("1.0",), r"opensource\.org/licenses/cpl"),
    ("isc", "isc", r"isc licen[sc]e", "isc licen", (), r"opensource\.org/licenses/isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib", (), r"opensource\.org/licenses/zlib"),
    ("boost", "bsl", r"boost software licen[sc]e", "boost", ("1.0",), r"boost\.org/license"),
    ("artistic", "artistic", r"artistic licen[sc]e", "artistic", ("1.0", "2.0"), r"opensource\.org/licenses/artistic"),
    ("ofl", "ofl", r"(?:sil )?open font licen[sc]e", "open font", ("1.0", "1.1"), r"scripts\.sil\.org/ofl"),
    ("odbl", "odbl", r"open database licen[sc]e", "open database", ("1.0",), r"opendatacommons\.org/licenses/odbl"),
    ("unlicense", "unlicense", r"the unlicense", "unlicense", (), r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"do what the f\w+ you want to public licen[sc]e", "want public", ("2.0",), r"wtfpl\.net"),
    ("public-domain", "cc0", r"(?:dedicated to|released into|placed in|in) the public domain", "public domain", (), r"creativecommons\.org/publicdomain"),
    ("cc0", "cc0", r"(?:(?:creative commons )?cc ?0|creative commons zero)(?: universal)?", "cc|commons 0|zero", ("1.0",), r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", "cc-by-nc-nd", r"(?:cc|creative commons)[ -](?:by|attribution)[ -]n(?:c|on-?commercial)[ -]n(?:d|o-?deriv\w*)", "cc|commons", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", "cc-by-nc-sa", r"(?:cc|creative commons)[ -](?:by|attribution)[ -]n(?:c|on-?commercial)[ -]s(?:a|hare-?alike)", "cc|commons", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", "cc-by-nc", r"(?:cc|creative commons)[ -](?:by|attribution)[ -]n(?:c|on-?commercial)", "cc|commons", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nc"),
    ("cc-by-nd", "cc-by-nd", r"(?:cc|creative commons)[ -](?:by|attribution)[ -]n(?:d|o-?deriv\w*)", "cc|commons", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", "cc-by-sa", r"(?:cc|creative commons)[ -](?:by|attribution)[ -]s(?:a|hare-?alike)", "cc|commons", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", "cc-by", r"(?:cc|creative commons)[ -](?:by|attribution)", "cc|commons", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by"),
    ("commercial", "licenseref-commercial", r"(?:commercial|proprietary) licen[sc]e", "commercial|proprietary", (), ""),
)

# Wordings of a notice around a license's name.
NOTICES = (
    r"(?:is |are )?(?:re)?licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{}",
    r"(?:is |are )?(?:released|distributed|published|available|provided|offered) under (?:the )?(?:terms of )?(?:the )?{}",
    r"under the terms (?:and conditions )?of (?:the )?{}",
    r"subject to (?:the )?(?:terms of )?(?:the )?{}",
)

# Sentences and statements of licenses and notices (label, kind, regex, the strings it needs).
STATEMENTS = (
    ("reserved", "notice", r"all rights (?:are )?reserved", "rights reserved"),
    ("reserved", "notice", r"no part of this (?:publication|book|document|work|site) may be", "part publication|book|document|work|site"),
    ("reserved", "notice", r"unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: of this \w+)? is (?:strictly )?prohibited", "unauthori prohibited"),
    ("copyright", "mention", r"(?:copyright|\(c\)|©) ?(?:\(c\)|©)? ?(?:19|20)\d\d", "copyright|(c)|©"),
    ("copyright", "mention", r"copyright by [\w.]+", "copyright"),
    ("no-redistribution", "notice", r"(?:may|must) not be (?:reproduced|copied|redistributed)", "not reproduced|copied|redistributed"),
    ("no-redistribution", "notice", r"redistribution (?:is )?(?:not permitted|prohibited|forbidden)", "redistribution permitted|prohibited|forbidden"),
    ("no-commercial-use", "notice", r"(?:for )?non-?commercial (?:use|purposes) only", "commercial only"),
    ("no-commercial-use", "notice", r"(?:not|no) (?:be used )?for commercial (?:use|purposes)", "commercial"),
    ("no-commercial-use", "notice", r"for (?:personal|private|educational|research) use only", "personal|private|educational|research only"),
    ("permissive", "notice", r"permission is hereby granted,? free of charge", "permission hereby granted"),
    ("permissive", "notice", r"redistribution and use in source and binary forms", "redistribution source binary"),
    ("permissive", "notice", r"the above copyright notice and this permission notice shall be included in all copies", "copyright permission included"),
    ("permissive", "notice", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright", "redistributions must copyright"),
    ("bsd-3-clause", "notice", r"neither the name of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse", "neither contributors endorse"),
    ("bsd-4-clause", "notice", r"all advertising materials mentioning features or use of this software must display", "advertising display"),
    ("bsd", "notice", r"this software is provided by the (?:copyright holders|regents|authors?) and contributors", "software provided contributors"),
    ("mit", "notice", r"the software is provided [\"“'‘]{0,2}as is[\"”'’]{0,2},? without warranty of any kind", "software provided warranty"),
    ("isc", "notice", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose", "permission copy modify software"),
    ("zlib", "notice", r"this software is provided ['‘\"]?as-is['’\"]?,? without any express or implied warranty", "software as-is implied"),
    ("zlib", "notice", r"altered source versions must be plainly marked as such", "altered plainly marked"),
    ("boost", "notice", r"to use, reproduce, display, distribute, execute,? and transmit the software", "reproduce transmit software"),
    ("apache", "notice", r"you may not use this file except in compliance with the licen[sc]e", "file except compliance"),
    ("apache", "notice", r"distributed on an [\"“]as is[\"”] basis, without warranties or conditions of any kind", "basis warranties conditions"),
    ("apache", "notice", r"licensed to the apache software foundation", "apache foundation"),
    ("gpl", "notice", r"this (?:program|library) is free software[:;,]? you can redistribute it", "free software redistribute"),
    ("gpl", "notice", r"either version \d(?:\.\d)? of the licen[sc]e,? or \(at your option\) any later version", "version option later"),
    ("gpl", "notice", r"you should have received a copy of the gnu (?:lesser |affero |library )?general public licen[sc]e", "received gnu general public"),
    ("gpl", "notice", r"without even the implied warranty of merchantability or fitness for a particular purpose", "implied merchantability fitness"),
    ("gfdl", "notice", r"with no invariant sections,? (?:with )?no front-cover texts", "invariant front-cover"),
    ("mpl", "notice", r"this source code form is subject to the terms of the mozilla public licen[sc]e", "source subject mozilla"),
    ("mpl", "notice", r"if a copy of the mpl was not distributed with this file", "mpl distributed file"),
    ("epl", "notice", r"this program and the accompanying materials are made available under the terms of the eclipse", "accompanying eclipse"),
    ("cddl", "notice", r"you may not use this file except in compliance with the common development and distribution", "compliance development distribution"),
    ("artistic", "notice", r"this is free software;? you can redistribute it (?:and/or modify it )?under the same terms as perl", "free redistribute perl"),
    ("unlicense", "notice", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("wtfpl", "notice", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document", "verbatim modified document"),
    ("fsf-verbatim", "notice", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document", "verbatim copies document"),
    ("cc0", "notice", r"to the extent possible under law,? .{1,160}? waived all copyright", "extent law waived"),
    ("cc0", "notice", r"no rights reserved", "no rights reserved"),
    ("public-domain", "notice", r"(?:this work|the author) (?:is|has been|hereby) (?:dedicated|dedicates|released|placed)[\w ]{0,40}? public domain", "public domain"),
    ("cc-by", "notice", r"this (?:work|article|page|content|text|photo) is licen[sc]ed under a creative commons attribution", "creative commons attribution"),
    ("creative-commons", "notice", r"some rights reserved", "some rights reserved"),
    ("creative-commons", "mention", r"creative commons licen[sc]es?", "creative commons"),
    ("ofl", "notice", r"the fonts and derivatives,? however,? cannot be released under any other type of licen[sc]e", "fonts derivatives released"),
    ("odbl", "notice", r"contents of this database are licensed under", "contents database"),
    ("crown-copyright", "notice", r"(?:©|\(c\)|\bcontains)? ?crown copyright", "crown copyright"),
    ("open-government", "title", r"open government licen[sc]e(?:,? v?\.? ?\d(?:\.\d)?)?", "open government"),
    ("gnu-all-permissive", "notice", r"copying and distribution of this file, with or without modification, are permitted in any medium", "copying modification medium"),
    ("beerware", "notice", r"if we meet some day,? and you think this stuff is worth it", "some day stuff"),
    ("trademark", "mention", r"(?:is a|are) (?:registered )?trademarks? of", "trademark"),
    ("patent-pending", "mention", r"patents? pending", "patent pending"),
    ("eula", "title", r"end[- ]user licen[sc]e agreement", "user agreement"),
    ("terms-of-use", "mention", r"(?:by using this (?:site|website|service|software),? you agree to|subject to our terms of (?:use|service))", "agree|terms"),
    ("public-license", "mention", r"\bpublic licen[sc]e", "public licen"),
)


def rules() -> list[Rule]:
    """The ordered rules: by priority of kind, then as listed (the more specific families come first)."""
    out = []

    def add(label: str, kind: str, pattern: str, needs: str) -> None:
        # a|b in `needs` means that either string will do
        groups = tuple(frozenset(x.split("|")) for x in needs.split())
        out.append(Rule(label, kind, groups, re.compile(rf"(?<!\w){_any_blanks(pattern)}")))

    for label, spdx, name, needs, versions, url in FAMILIES:
        for version in versions or ("",):
            tail = re.escape(f"-{version}") if version else ""
            add(label, "spdx", rf"spdx-license-identifier: ?{re.escape(spdx)}{tail}(?:-only|-or-later|\+)?(?![\w.-])", "spdx license")
        if url:
            add(label, "url", rf"(?:https?://)?(?:www\.)?{url}[\w./-]*", _host_word(url))
        for wording in NOTICES:
            for version in (*versions, ""):
                number = rf",? (?:version |v\.? ?)?{re.escape(version).removesuffix(re.escape('.0'))}(?:\.0)?(?![\d.]*\d)" if version else ""
                add(label, "notice", wording.format(rf"(?:{name})") + number, f"under {needs}" if "under" in wording else f"subject {needs}")
        for version in versions:
            number = re.escape(version).removesuffix(re.escape(".0"))
            add(label, "title", rf"(?:{name})(?: licen[sc]e)?,? (?:version |v\.? ?)?{number}(?:\.0)?(?![\d.]*\d)", needs)
        add(label, "mention", rf"(?:{name})(?![\w-])", needs)
    for label, kind, pattern, needs in STATEMENTS:
        add(label, kind, pattern, needs)
    return sorted(out, key=lambda r: PRIORITY[r.kind])


def _any_blanks(pattern: str) -> str:
    """The pattern with each blank outside of brackets as any run of white space (an optional one: as one of any kind)."""
    out, inside = [], False
    for c, following in zip(pattern, [*pattern[1:], ""], strict=True):
        inside = c == "[" or (inside and c != "]")
        out.append(c if c != " " or inside else r"\s" if following == "?" else r"\s+")
    return "".join(out)


def _host_word(url: str) -> str:
    """The keyword of an address: its site's name."""
    host = url.split("/")[0].replace("(?:joinup\\.ec\\.)?", "").split("\\.")
    return host[-2] if len(host) > 1 else host[0]


def _hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return w.hashes(data, np.array([0]), np.array([len(data)]))[0]


class Scanner:
    """Rules, and phrases as word hashes; built once in each worker."""

    _own: Scanner | None = None

    def __init__(self) -> None:
        self.rules = rules()
        self.words = sorted({k for r in self.rules for group in r.keywords for k in group})
        self.chosen: dict[tuple[str, ...], list[int]] = {}  # rules by the keywords that a text contains
        self.phrases = [(label, [_hash(x) for x in phrase.split()]) for phrase, label in BASE.items()]

    @classmethod
    def get(cls) -> Scanner:
        cls._own = cls._own or cls()
        return cls._own

    def detect(self, text: str) -> list[tuple[int, int, int]]:
        """(rule, start, end) of the detections that stand in a lower-cased text: none lies inside one that was taken before it."""
        present = tuple(k for k in self.words if k in text)
        if present not in self.chosen:
            if len(self.chosen) > 5000:
                self.chosen.clear()
            self.chosen[present] = [i for i, r in enumerate(self.rules) if all(not group.isdisjoint(present) for group in r.keywords)]
        found = []
        for i in self.chosen[present]:
            r = self.rules[i]
            found += [(m.start(), -m.end(), PRIORITY[r.kind], i) for m in r.regex.finditer(text)]
        return resolve(found)

    def scan(self, column: pa.Array) -> list[list]:
        out: list[list] = [[] for _ in range(8)]
        texts = column
        for at, end, hashed, first in w.words(column, w.ALNUM):
            n = end - at
            row, label = [], []
            starts = []
            inner = np.ones(len(hashed) + 1, bool)
            inner[first] = False  # whether a word continues its predecessor's text
            for i, (_, parts) in enumerate(self.phrases):
                hit = hashed[: len(hashed) - len(parts) + 1] == parts[0] if len(hashed) >= len(parts) else np.zeros(0, bool)
                for k in range(1, len(parts)):
                    hit &= (hashed[k : k + len(hit)] == parts[k]) & inner[k : k + len(hit)]
                where = np.flatnonzero(hit)
                starts += where.tolist()
                row += (np.searchsorted(first, where, "right") - 1).tolist()
                label += [i] * len(where)
            places: dict[int, list[tuple[int, int]]] = {}
            for s, r, i in zip(starts, row, label, strict=True):
                places.setdefault(r, []).append((s - int(first[r]), i))
            for r in range(n):
                base = sorted(places.get(r, []))
                names = sorted({self.phrases[i][0] for _, i in base})
                kept = self.detect((texts[at + r].as_py() or "").lower())
                doubt = (1 - CERTAINTY["base"]) ** len(names)
                best: dict[str, float] = {}
                for rule, _, _ in kept:
                    x = self.rules[rule]
                    best[x.label] = max(best.get(x.label, 0.0), CERTAINTY[x.kind])
                for c in best.values():
                    doubt *= 1 - c
                values = (
                    int(first[r + 1] - first[r]), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(names), ",".join(sorted({*names, *best})), 1 - doubt,
                    [{"label": self.rules[rule].label, "rule": rule, "start": s, "end": e} for rule, s, e in kept],
                )
                for column_, value in zip(out, values, strict=True):
                    column_.append(value)
        return out


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(rule, start, end) that stand, of (start, -end, priority, rule).

    Containment is transitive, so a match goes if any match of better or equal
    priority contains it: one sweep by start for each priority decides.
    """
    kept = []
    for level in sorted({x[2] for x in found}):
        reach = -1
        for start, end, priority, rule in sorted(x for x in found if x[2] <= level):
            if priority == level and -end > reach:
                kept.append((rule, start, -end))
            reach = max(reach, -end)
    return sorted(kept, key=lambda x: x[1:])


def scan(docs: DataFrame, text: str = "text", name: str = "license") -> tuple[DataFrame, str]:
    """docs with a struct column of FIELDS, and that column's name; detections are in characters of the lower-cased text."""
    name = fresh(docs, name)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct({"label": pa.string(), "rule": pa.int32(), "start": pa.int64(), "end": pa.int64()}))]
    return add_struct(docs, text, FIELDS, lambda column: [pa.array(x, k) for x, k in zip(Scanner.get().scan(column), kinds, strict=True)], name), name


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    scanned, name = scan(narrow(docs, doc_id=doc_id, text=text))
    return scanned.select("doc_id", *[f"{name}.{x}" for x in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])
