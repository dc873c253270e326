"""Operator 10: license scans by sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

A template is the notice by which a license is granted, or the text of a license (the short ones whole, the long ones by
title and opening). Every line of every file is a candidate notice: the words of
the line (letters and digits, lower-cased) are weighted by their count times their inverse frequency among the
templates (words of no template have the highest), and compared with all templates by the cosine. Only words of
templates contribute to the product, so it is summed over a small inverted index; the line's length counts all of
its words. Neighbouring lines are also compared as one, so that a wrapped notice is found, and so is every run of as many
words as the template has, regardless of line ends (a notice inside prose, a whole license file). A template counts only
where all words that tell its license from others stand (``NEED``) and none of a near relative's (``BARRED``); version
and BSD clauses are then read from the words that follow. An SPDX tag names its license itself, also one without a
template (cosine 1; ``-only`` and ``-or-later`` are left off, operators stay; several different tags are joined by AND). A
sentence that offers a choice ("dual licensed under") names all licenses it mentions, joined by OR. A notice that says "not
licensed under" grants nothing. A file's own license is that of its best
tag, line or run at ``LEAST`` or more (ties: the earlier line).

A license file (LICENSE, LICENCE, COPYING or NOTICE, with any ending) grants its license to its directory. A file
without a license of its own takes that of the nearest directory above it: each file asks for its directories by a
join on the path, and the longest that grants one wins; a hot directory is one row on the granting side. Two license
files in one directory: the higher cosine, then the smaller name.

Null and empty texts have no license of their own, rows without a path inherit nothing; repeated rows each give a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import cut, slices, texts

#: Short public license notices.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
}
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.")
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software "
        "Foundation, either version {1} of the License, or (at your option) any later version.")
#: Notices and texts that only tell licenses apart together with ``NEED`` and ``BARRED``.
MORE = {
    "MIT": ["Licensed under the MIT License.", "The MIT License (MIT)",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
            "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software. " + _AS_IS],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "GPL-3.0": [_GNU.format("General Public License", 3), "Licensed under the GPL v3.", "Released under the GPLv3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                "Licensed under the GNU GPL, version 3."],
    "LGPL-3.0": [_GNU.format("Lesser General Public License", 3), "Licensed under the LGPL v3.", "Released under the LGPLv3.",
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": [_GNU.format("Affero General Public License", 3), "Licensed under the AGPL v3.", "Released under the AGPLv3.",
                 "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the MPL 2.0."],
    "BSD-3-Clause": [_BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission.", "Licensed under the BSD 3-Clause License."],
    "BSD-2-Clause": [_BSD, "Licensed under the BSD 2-Clause License."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSL-1.0": ["Boost Software License - Version 1.0", "Distributed under the Boost Software License, Version 1.0.",
                "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                "documentation covered by this license"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.",
                "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.",
                  "For more information, please refer to https://unlicense.org"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Licensed under CC0.", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Legal Code CC0 1.0 Universal"],
}
_CC = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
NEED = {"MIT": [{"mit", "license"}, {"permission", "granted", "charge"}], "Apache-2.0": [{"apache", "license"}, {"apache", "licensed"}, {"apache", "spdx"}],
        "GPL-3.0": [{"gnu", "general", "public"}, {"gpl"}, {"gplv3"}], "LGPL-3.0": [{"gnu", "lesser", "general"}, {"lgpl"}, {"lgplv3"}],
        "AGPL-3.0": [{"gnu", "affero", "general"}, {"agpl"}, {"agplv3"}], "MPL-2.0": [{"mozilla", "public"}, {"mpl"}],
        "BSD-3-Clause": [{"redistribution", "source", "binary", "permitted"}, {"bsd", "3", "clause"}],
        "BSD-2-Clause": [{"redistribution", "source", "binary", "permitted"}, {"bsd", "2", "clause"}],
        "ISC": [{"isc", "license"}, {"permission", "fee", "granted"}], "BSL-1.0": [{"boost", "license"}, {"permission", "granted", "organization"}],
        "OFL-1.1": [{"sil", "font", "license"}, {"permission", "granted", "font"}], "Unlicense": [{"unencumbered", "domain"}, {"unlicense"}],
        "CC0-1.0": [{"cc0"}]}
_LESS = {"affero", "agpl", "agplv3", "lesser", "lgpl", "lgplv3", "library"}
BARRED = {"MIT": {"organization", "font", "fee"}, "GPL-3.0": _LESS, "LGPL-3.0": {"affero"}, "AGPL-3.0": {"lesser"}, "OFL-1.1": {"organization"},
          "BSD-2-Clause": {"endorse"}}
for _on in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
    _name = "-".join(["CC-BY", *(x.upper() for x in _on), "4.0"])
    _kind = "-".join(["Attribution", *(_CC[x] for x in _on)])
    MORE[_name] = [f"Licensed under {' '.join(['CC', '-'.join(['BY', *(x.upper() for x in _on)])])} 4.0.", f"Creative Commons {_kind} 4.0 International",
                   f"This work is licensed under a Creative Commons {_kind} 4.0 International License."]
    NEED[_name] = [{"cc", "by", *_on}, {"commons", "attribution", *(_CC[x].lower() for x in _on)}]
    BARRED[_name] = {w for x in _CC if x not in _on for w in (x, _CC[x].lower(), *(["noderivs"] if x == "nd" else []))}
ALL = {name: TEMPLATES.get(name, []) + MORE.get(name, []) for name in [*TEMPLATES, *(n for n in MORE if n not in TEMPLATES)]}
#: Words of another license family end the part that is read for a version.
_FAMILIES = {"Apache": "apache", "GPL": "gnu|[al]?gpl", "LGPL": "gnu|[al]?gpl", "AGPL": "gnu|[al]?gpl", "MPL": "mozilla|mpl", "CC": "creative commons|cc by"}
_VERSION = re.compile(r"(?:\bv|\bver|\bversion|gplv)[ .]*(\d(?:\.\d)?)\b|(?:\b|[a-z]-)(\d\.\d)\b|\bgpl[ -](\d(?:\.\d)?)\b")
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I)
SPDX_IDS = {n.lower(): n for n in [*ALL, "0BSD", "Zlib", "EPL-2.0", "GPL-1.0", "GPL-2.0", "LGPL-2.0", "LGPL-2.1", "MIT-0", "MPL-1.1", "Apache-1.1", "CC-BY-3.0"]}
LEAST = 0.6
#: Words that offer a choice of licenses, that refuse one, and by which licenses are named in a sentence.
DUAL = re.compile(r"\b(?:dual|dually|multi|double)[- ]?licensed\b|\b(?:licensed|available) under (?:either|both)\b")
NOT_GRANTED = re.compile(r"\b(?:not|no longer|never|isn't|aren't)\s+(?:\w+\s+){0,2}?(?:licensed|released|distributed|available|provided|covered)\s+(?:under|by)\b")
MENTIONS = {r"\bmit\b": "MIT", r"\bapache\b": "Apache-2.0", r"\bisc\b": "ISC", r"\bbsd\b": "BSD-3-Clause", r"\b(?:mozilla|mpl)\b": "MPL-2.0",
            r"\b(?:agpl|gnu affero)\b": "AGPL-3.0", r"\b(?:lgpl|gnu lesser)\b": "LGPL-3.0", r"\b(?:gpl|gplv\d|gnu general|gnu gpl)\b": "GPL-3.0",
            r"\bcc0\b": "CC0-1.0", r"\bunlicense\b": "Unlicense"}
WORD = re.compile(r"[a-z0-9]+")
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"


class Index:
    """Inverted index of the templates: word -> (template, weight); weights of a template have unit length."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, need: dict[str, list[set]] | None = None, barred: dict[str, set] | None = None):
        docs = [(name, Counter(WORD.findall(t.lower()))) for name, ts in templates.items() for t in ts]
        n, df = len(docs), Counter(w for _, c in docs for w in c)
        self.idf = {w: 1 + math.log((1 + n) / (1 + k)) for w, k in df.items()}
        self.other = 1 + math.log(1 + n)
        self.names = [name for name, _ in docs]
        self.words: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, (_, c) in enumerate(docs):
            norm = math.sqrt(sum((k * self.idf[w])**2 for w, k in c.items()))
            for w, k in c.items():
                self.words[w].append((i, k * self.idf[w] / norm))
        self.need = [next((s for s in (need or {}).get(name, ()) if s <= c.keys()), set()) for name, c in docs]
        self.barred = [(barred or {}).get(name, set()) - c.keys() for name, c in docs]
        self.ruled = need is not None
        self.place = {w: i for i, w in enumerate(sorted({*self.idf, *(w for x in self.barred for w in x)}))}
        self.size = [sum(c.values()) for _, c in docs]
        self.gain = np.zeros((len(docs), len(self.place) + 1))  # the last place: words of no template
        self.square = np.full(len(self.place) + 1, self.other**2)
        for w, at in self.place.items():
            self.square[at] = self.idf.get(w, self.other)**2
            for i, v in self.words.get(w, ()):
                self.gain[i, at] = self.idf[w] * v
        if self.ruled:
            assert all(self.need), "a template without words that it needs"
            rare = sorted({max(s, key=lambda w: (self.idf[w], w)) for s in self.need})
            self.anchor = re.compile(r"(?<![a-z0-9])(?:" + "|".join(rare) + r")(?![a-z0-9])")

    def may(self, i: int, words) -> bool:
        return self.need[i] <= words and not self.barred[i] & words

    def counted(self, line: str) -> tuple[Counter, float, float]:
        """Word counts of a line, and the squared weights of its template words and of all its words."""
        count = Counter(WORD.findall(line))
        known = every = 0.0
        for w, k in count.items():
            v = (k * self.idf.get(w, self.other))**2
            every += v
            if w in self.idf:
                known += v
        return count, known, every

    def best(self, count: Counter) -> tuple[float, str | None]:
        """Highest cosine of a line's word counts, and its license."""
        product = [0.0] * len(self.names)
        norm = 0.0
        for w, k in sorted(count.items()):
            weight = k * self.idf.get(w, self.other)
            norm += weight * weight
            for i, v in self.words.get(w, ()):
                product[i] += weight * v
        if self.ruled:
            product = [p if p > 0 and self.may(i, count.keys()) else 0.0 for i, p in enumerate(product)]
        top = max(product)
        if top <= 0:
            return 0.0, None
        return round(top / math.sqrt(norm), 9), min(self.names[i] for i, p in enumerate(product) if p == top)

    def scan(self, text: str) -> tuple[str | None, float, int]:
        """Own license of a whole text, its cosine and line (from 1; 0: none).

        A cosine is at most the root of the template words' part of the squared weights (Cauchy-Schwarz), and counts
        of two lines together have at most twice the sum of their squares: lines below that bound are passed over.
        """
        found, after, floor = (0.0, 0, None), None, LEAST * LEAST
        lines = text.lower().split("\n")
        for i in range(len(lines) - 1, -1, -1):
            here = self.counted(lines[i])
            tries = [here[0]] if here[1] >= floor * here[2] > 0 else []
            if after is not None and after[2] and 2 * (here[1] + after[1]) >= floor * (here[2] + after[2]) > 0:
                tries.append(here[0] + after[0])
            for count in tries:
                c, name = self.best(count)
                if c >= LEAST and c >= found[0]:
                    found = (c, i + 1, name)
            after = here
        return found[2], found[0], found[1]

    def runs(self, low: str, least: float) -> tuple[float, int, str | None]:
        """Highest cosine (above ``least``) of a run of as many words as a template has, its first character and license.

        The squares of the counts are at least the counts, so the sums over single words bound the cosine from above;
        runs are worked out exactly from the highest bound down, until none can be better.
        """
        spans = [(m.start(), m[0]) for m in WORD.finditer(low)]
        have = {w for _, w in spans}
        best = (least, -1, None)
        todo = [i for i in range(len(self.names)) if self.need[i] <= have]
        if not todo:
            return best
        at = np.array([self.place.get(w, len(self.place)) for _, w in spans])

        def moving(x, n):
            total = np.concatenate([[0.0], np.cumsum(x)])
            return total[n:] - total[:-n]

        for i in todo:
            n = min(self.size[i], len(at))
            bound = moving(self.gain[i][at], n) / np.sqrt(moving(self.square[at], n))
            ok = bound >= max(best[0], LEAST) - 1e-9
            for w in self.need[i]:
                ok &= moving(at == self.place[w], n) > 0.5
            for w in self.barred[i] & have:
                ok &= moving(at == self.place[w], n) < 0.5
            left = np.flatnonzero(ok)
            seen = set()
            for s in left[np.lexsort((left, -np.round(bound[left], 9)))].tolist():
                if bound[s] < best[0] - 1e-9:
                    break
                run = at[s:s + n]
                key = run.tobytes()
                if key in seen and best[1] <= spans[s][0]:
                    continue  # the same words again, further down
                if len(seen) < 10_000:
                    seen.add(key)
                count = Counter(w for _, w in spans[s:s + n])
                norm = math.sqrt(sum((k * self.idf.get(w, self.other))**2 for w, k in count.items()))
                c = round(float(self.gain[i][run].sum()) / norm, 9)
                if c >= LEAST and (c > best[0] or c == best[0] and best[2] is not None and
                                   (spans[s][0], self.names[i]) < (best[1], best[2])):
                    best = (c, spans[s][0], self.names[i])
        return best

    def own(self, text: str) -> tuple[str | None, float, int]:
        """Own license of a whole text by tags, lines and runs of words, its cosine and line (from 1; 0: none)."""
        low, got = text.lower(), []
        tags = [(name, m.start()) for m in SPDX.finditer(text) if (name := spdx(m[1]))]
        if tags:  # parts of a file under several licenses: all of them hold
            names = list(dict.fromkeys(name for name, _ in tags))
            several = [f"({n})" if " OR " in n else n for n in names] if len(names) > 1 else names
            got.append((-1.0, text.count("\n", 0, tags[0][1]) + 1, " AND ".join(several)))
        for m in DUAL.finditer(low):
            if not refused(low, m.start()) and len(names := mentions(low, m.end())) > 1:
                got.append((-1.0, text.count("\n", 0, m.start()) + 1, " OR ".join(names)))
                break
        if self.anchor.search(low):  # every template needs one of these words
            name, c, line = self.scan(text)
            if name:
                start = sum(len(x) + 1 for x in low.split("\n", line - 1)[:line - 1])
                if refused(low, start):
                    c = 0.0
                else:
                    got.append((-c, line, told(name, low, start)))
            c, start, name = self.runs(low, c)
            if name and not refused(low, start):
                got.append((-c, low.count("\n", 0, start) + 1, told(name, low, start)))
        if not got:
            return None, 0.0, 0
        c, line, name = min(got)
        return name, -c, line


def refused(low: str, start: int) -> bool:
    """Whether the notice that begins at ``start`` says that the license is not granted."""
    begin = low.rfind("\n", 0, start) + 1
    return any(begin + m.end() >= start - 5 and begin + m.start() <= start + 40 for m in NOT_GRANTED.finditer(low[begin:start + 120]))


def mentions(low: str, start: int) -> list[str]:
    """Licenses named in the sentence that goes on at ``start``, in order."""
    rest = low[start:start + 300]
    rest = rest[:m.start()] if (m := re.search(r"\.(?:\s|$)", rest)) else rest
    found = sorted((m.start(), name) for pattern, name in MENTIONS.items() for m in re.finditer(pattern, rest))
    return list(dict.fromkeys(told(name, low, start + at) for at, name in found))


def told(name: str, low: str, start: int) -> str:
    """The license with the version, or the clauses, that the words from ``start`` on tell."""
    if name.startswith("BSD-"):
        after = low[start:start + 2500]
        if re.match(r"[^\n]{0,200}\b[234][- ]clause", after):
            return f"BSD-{re.search(r'([234])[- ]clause', after)[1]}-Clause"
        if "advertising materials" in after:
            return "BSD-4-Clause"
        if re.search(r"\bendorse\b", after):
            return "BSD-3-Clause"
        return "BSD-2-Clause" if "disclaimer" in after or name == "BSD-2-Clause" else name
    family = name.split("-")[0]
    if family not in _FAMILIES:
        return name
    after = low[start:start + 400]
    for f, words in _FAMILIES.items():
        if words != _FAMILIES[family] and (m := re.search(rf"\b(?:{words})\b", after)):
            after = after[:m.start()]
    if not (m := _VERSION.search(after)):
        return name
    version = next(x for x in m.groups() if x)
    return "-".join([*name.split("-")[:-1], version if "." in version else version + ".0"])


def spdx(rest: str) -> str | None:
    """The license expression at the beginning of what follows an SPDX tag, in the names used here."""
    out, depth, wanted = [], 0, True
    for word in re.findall(r"[()]|[A-Za-z0-9.+:_-]+|\S", rest):
        if wanted and word == "(":
            out.append(word)
            depth += 1
        elif not wanted and word == ")" and depth:
            out.append(word)
            depth -= 1
        elif not wanted and word.upper() in ("AND", "OR", "WITH"):
            out.append(word.upper())
            wanted = True
        elif wanted and re.match(r"[A-Za-z0-9]", word):
            plain = re.sub(r"(?i)(-only|-or-later|\+)$", "", word.rstrip(".:"))
            out.append(SPDX_IDS.get(plain.lower(), plain))
            wanted = False
        else:
            break
    while out and out[-1] in ("AND", "OR", "WITH", "("):
        depth -= out.pop() == "("
    return " ".join(out + [")"] * depth).replace("( ", "(").replace(" )", ")") or None


def scan_files(files: DataFrame) -> DataFrame:
    """``doc_id, path, own_license, cosine, line`` of every file."""
    def run(batches):
        index = Index(ALL, NEED, BARRED)
        for batch in batches:
            for part in slices(batch, "text"):
                got = [index.own(t) for t in texts(part, "text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                     pa.array([g[2] for g in got], pa.int64())], ["doc_id", "path", "own_license", "cosine", "line"])

    need = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return need.mapInArrow(run, "doc_id long, path string, own_license string, cosine double, line long")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds ``license`` and ``granted_by`` ("own", a directory, or null)."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    grants = scanned.where(F.col("own_license").isNotNull() & name.rlike(LICENSE_FILE)).groupBy(folder.alias("folder")).agg(
        F.min(F.struct((-F.col("cosine")).alias("far"), F.col("path").alias("by"), F.col("own_license").alias("grants"))).alias("g"))
    grants = grants.select("folder", "g.grants")
    steps = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.concat_ws("/", F.slice(steps, 1, n)))
    asking = scanned.where("own_license IS NULL AND path IS NOT NULL").select("path").distinct()
    asked = asking.select("path", F.explode(F.array_distinct(above)).alias("folder")).join(grants, "folder")
    near = asked.groupBy("path").agg(F.max(F.struct(F.length("folder").alias("n"), "folder", "grants")).alias("x"))
    near = near.select(F.col("path").alias("of_path"), F.col("x.folder").alias("folder"), F.col("x.grants").alias("grants"))
    got = scanned.join(near, (scanned.path == near.of_path) & scanned.own_license.isNull(), "left")
    return got.select("doc_id", "path", "own_license", "cosine", "line", F.coalesce("own_license", "grants").alias("license"),
                      F.when(F.col("own_license").isNotNull(), "own").otherwise(F.col("folder")).alias("granted_by"))


def scan(files: DataFrame) -> DataFrame:
    """License of every file, its own or inherited; the texts are scanned once, the findings checkpointed."""
    return inherit(cut(scan_files(files)))
