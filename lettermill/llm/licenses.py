"""License scans: TF-IDF cosine of headers and license files to templates, then nearest-ancestor inheritance.

Units of comparison. The header (the comment lines and blank lines at the start) and, in license
files, the whole text are compared with templates of whole notices. Every line, every paragraph
(between blank lines or lines of marks alone) and every sentence of a paragraph is compared with
templates of single statements, so a statement is found wrapped, behind comment marks or beside
other sentences. Vectors hold term counts times idf; terms are runs of a-z and 0-9 of the
lower-cased text. idf(t) = ln((1 + N) / (1 + df(t))) + 1 over all N texts; terms of no template have
df 0, so foreign words lower a unit's cosine. A unit matches from a cosine of MIN_COSINE on, if it
holds what tells the license from its neighbours (MARKS): terms of each of its groups, such as the
number of the version and `lesser`, and none of the terms that speak of another license. A unit
whose best two licenses of a rank are less than MARGIN apart matches none: no license is better than
a wrong one. Licenses that few use have templates, too, as competitors of those that many use. The
best match gives the file its own license: a whole notice before a statement, a statement before
those of LAST (which stand beside other licenses, too), then the higher score, then the first name.
Tags (`SPDX-License-Identifier: MIT`) and titles (`MIT License`) are statements.

Texts without a required term are skipped without loss: ordering a template's terms by idf, the
common rest whose norm is below MIN_COSINE of the template's cannot reach the threshold alone.

License files (LICENSE, LICENCE, COPYING, NOTICE, with any ending) hand their license to the files
of their directory and of those below it that have none of their own and no nearer one: the
distinct directories are joined with those that have a license file, on each ancestor path. Of
several license files in a directory the one with the best match hands on, by path among equals.

All work on texts happens within their row; shuffles carry ids, paths and licenses only.

Cases: a null text has no license of its own. A null path is in no directory and inherits nothing.
Empty texts and lines match nothing. Texts of any length are read whole. Repeated rows give repeated
rows. Empty tables give empty results. Only id, path and text are read, so further columns cannot
clash.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import cut

MIN_COSINE = 0.8
MARGIN = 0.01
_NOT_TERM = "[^a-z0-9]+"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)(\..*)?$"
# What starts a comment line, what parts paragraphs, and what ends a sentence.
COMMENT_LINE = r"^[ \t]*(#|//|/\*|\*|--|;|%|<!--|\z)"
PARAGRAPHS = r"\n[^A-Za-z0-9\n]*\n"
SENTENCES = r"[.:;!?][\"')]*\s+"

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_USE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_KEEP = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_USE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
_APACHE_REST = (
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under "
    "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GPL_USE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version."
)
_GPL_REST = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_MPL_REST = "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."

_MIT0_GRANT = _MIT_GRANT.replace(", subject to the following conditions:", ".")
_MIT_DISCLAIMER = _MIT_REST[_MIT_REST.index("THE SOFTWARE") :]
_MPL1 = (
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.mozilla.org/MPL/"
)


def _gnu(name: str, version: str, thing: str = "program") -> tuple[str, str]:
    """The usual notice of a GNU license: the grant, and the whole of it."""
    use = _GPL_USE.replace("GNU General Public License", name).replace("version 3", f"version {version}").replace("This program", f"This {thing}")
    rest = _GPL_REST.replace("GNU General Public License", name).replace("program", thing)
    return use, f"{use} {rest}"


#: GNU licenses as (license, name in notices, version, name in tags).
_GNU = (
    ("GPL-2.0", "GNU General Public License", "2", "GPL-2.0"),
    ("GPL-3.0", "GNU General Public License", "3", "GPL-3.0"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "LGPL-2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "LGPL-3.0"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "AGPL-3.0"),
)
#: Creative Commons licenses as (license, letters, words).
_CC = (
    ("CC-BY-4.0", "BY", "Attribution"),
    ("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike"),
    ("CC-BY-NC-4.0", "BY-NC", "Attribution-NonCommercial"),
    ("CC-BY-ND-4.0", "BY-ND", "Attribution-NoDerivatives"),
    ("CC-BY-NC-SA-4.0", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("CC-BY-NC-ND-4.0", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
_DATES = {"GPL-2.0": "Version 2, June 1991", "GPL-3.0": "Version 3, 29 June 2007", "LGPL-2.1": "Version 2.1, February 1999", "LGPL-3.0": "Version 3, 29 June 2007", "AGPL-3.0": "Version 3, 19 November 2007"}

# The wording of statements (part) and of whole notices by which licenses are declared.
TEMPLATES = (
    ("Apache-2.0", "part", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "part", _APACHE_USE),
    ("BSD-3-Clause", "part", _BSD_USE),
    ("CC-BY-4.0", "part", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "part", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "part", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "part", _GPL_USE),
    ("ISC", "part", _ISC),
    ("MIT", "part", "Released under the MIT License."),
    ("MIT", "part", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "part", _MIT_GRANT),
    ("MPL-2.0", "part", _MPL),
    ("proprietary", "part", "All rights reserved."),
    # titles
    ("Apache-2.0", "part", "Apache License Version 2.0"),
    ("Apache-2.0", "part", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "part", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "part", "BSD 2-Clause License"),
    ("BSD-3-Clause", "part", "BSD 3-Clause License"),
    ("ISC", "part", "ISC License"),
    ("MIT", "part", "MIT License"),
    ("MIT", "part", "The MIT License (MIT)"),
    ("MIT-0", "part", "MIT No Attribution"),
    ("MPL-2.0", "part", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "part", "Mozilla Public License Version 1.1"),
    # competitors
    ("MIT-0", "part", _MIT0_GRANT),
    ("MPL-1.1", "part", _MPL1),
    *[row for license, name, version, tag in _GNU for row in (
        (license, "part", f"{name} {_DATES[license]}"),
        (license, "part", f"{name} v{version}"),
        (license, "part", f"This work is licensed under the {name}, version {version}."),
        (license, "part", _gnu(name, version)[0]),
        (license, "part", _gnu(name, version, "library")[0]),
    ) if row != ("GPL-3.0", "part", "This work is licensed under the GNU General Public License, version 3.") and row != ("GPL-3.0", "part", _GPL_USE)],
    *[row for license, letters, words in _CC for row in (
        (license, "part", f"Licensed under CC {letters} 4.0."),
        (license, "part", f"Creative Commons {words} 4.0 International License"),
        (license, "part", f"This work is licensed under a Creative Commons {words} 4.0 International License."),
    ) if row[2] not in ("Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.")],
    # tags
    *[(license, "part", f"SPDX-License-Identifier: {license}") for license in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", *[c[0] for c in _CC])],
    *[(license, "part", f"SPDX-License-Identifier: {tag}{end}") for license, _, _, tag in _GNU for end in ("", "-only", "-or-later")],
    ("Apache-2.0", "whole", f"{_APACHE_USE} {_APACHE_REST}"),
    ("BSD-2-Clause", "whole", f"{_BSD_USE} {_BSD_KEEP} {_BSD_REST}"),
    ("BSD-3-Clause", "whole", f"{_BSD_USE} {_BSD_KEEP} {_BSD_NAME} {_BSD_REST}"),
    ("GPL-3.0", "whole", f"{_GPL_USE} {_GPL_REST}"),
    ("ISC", "whole", f"{_ISC} {_ISC_REST}"),
    ("MIT", "whole", f"{_MIT_GRANT} {_MIT_REST}"),
    ("MPL-2.0", "whole", f"{_MPL} {_MPL_REST}"),
    ("MIT-0", "whole", f"{_MIT0_GRANT} {_MIT_DISCLAIMER}"),
    *[(license, "whole", _gnu(name, version, thing)[1]) for license, name, version, _ in _GNU for thing in ("program", "library") if (license, thing) != ("GPL-3.0", "program")],
)
_SA, _NC, _ND = ("sa", "sharealike"), ("nc", "noncommercial"), ("nd", "noderivatives", "noderivs")
_OTHER_GNU = ("lesser", "library", "affero", "lgpl", "agpl")
# What tells a license from its neighbours, as groups of terms of each of which a unit holds one, and terms that it holds none of.
MARKS: dict[str, tuple[tuple[tuple[str, ...], ...], tuple[str, ...]]] = {
    "Apache-2.0": ((("apache",), ("2",)), ()),
    "BSD-2-Clause": ((("2", "redistributions"),), ("3", "4", "endorse")),
    "BSD-3-Clause": ((("3", "redistribution", "redistributions"),), ("2", "4")),
    "ISC": ((("isc", "permission"),), ("mit",)),
    "MIT": ((("mit", "permission"),), ("isc", "attribution")),
    "MIT-0": ((("0", "attribution", "permission"),), ("isc", "following")),
    "MPL-1.1": ((("1",), ("mozilla", "mpl")), ("0", "2")),
    "MPL-2.0": ((("2",), ("mozilla", "mpl")), ("1",)),
    "GPL-2.0": ((("2", "v2"), ("general", "gpl")), ("1", "3", "v3", *(t for t in _OTHER_GNU if t != "library"))),
    "GPL-3.0": ((("3", "v3"), ("general", "gpl")), ("1", "2", "v2", *(t for t in _OTHER_GNU if t != "library"))),
    "LGPL-2.1": ((("2", "v2"), ("1",), ("lesser", "lgpl")), ("3", "v3", "affero")),
    "LGPL-3.0": ((("3", "v3"), ("lesser", "lgpl")), ("1", "2", "v2", "affero")),
    "AGPL-3.0": ((("3", "v3"), ("affero", "agpl")), ("1", "2", "v2", "lesser")),
    "CC-BY-4.0": ((("4",),), (*_SA, *_NC, *_ND, "1", "2", "3")),
    "CC-BY-SA-4.0": ((("4",), _SA), (*_NC, *_ND, "1", "2", "3")),
    "CC-BY-NC-4.0": ((("4",), _NC), (*_SA, *_ND, "1", "2", "3")),
    "CC-BY-ND-4.0": ((("4",), _ND), (*_SA, *_NC, "1", "2", "3")),
    "CC-BY-NC-SA-4.0": ((("4",), _NC, _SA), (*_ND, "1", "2", "3")),
    "CC-BY-NC-ND-4.0": ((("4",), _NC, _ND), (*_SA, "1", "2", "3")),
}
#: Licenses whose statements count only if no other license is found.
LAST = ("proprietary",)

Templates = Sequence[tuple[str, str, str]]


def marked(name: str, found: set[str]) -> bool:
    """True if the terms tell the license from its neighbours."""
    groups, others = MARKS.get(name, ((), ()))
    return all(found & set(g) for g in groups) and not found & set(others)


def terms(text: str) -> list[str]:
    return [t for t in re.split(_NOT_TERM, text.lower()) if t]


def _split(text: Column) -> Column:
    """The terms of a text, with an empty one at an end that is no term."""
    return F.split(F.lower(text), _NOT_TERM)


def _terms(text: Column) -> Column:
    return F.filter(_split(text), lambda t: t != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bag(found: Column) -> Column:
    """array<struct<term, n>>: the distinct terms and their counts, by the starts of runs in the sorted terms."""

    def counted(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _let(starts, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).cast("double").alias("n"))))

    return _let(F.array_sort(found), counted)


class Scorer:
    """Template vectors under the corpus's idf, as column expressions."""

    def __init__(self, templates: Templates, df: dict[str, int], n: int):
        self.unknown = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, _, text in templates for t in terms(text)}
        self.rows: list[tuple[str, str, dict[str, float]]] = []
        self.required: dict[str, set[str]] = {"part": set(), "whole": set()}
        for name, kind, text in templates:
            weights = {t: c * self.idf[t] for t, c in Counter(terms(text)).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.rows.append((name, kind, {t: w / norm for t, w in weights.items()}))
            rest = 0.0
            for t in sorted(weights, key=lambda t: (self.idf[t], t)):
                rest += (weights[t] / norm) ** 2
                # a margin keeps rounding on the safe side
                if math.sqrt(rest) >= MIN_COSINE - 1e-9:
                    self.required[kind].add(t)

    def _lacks(self, found: Column, kind: str) -> Column:
        return ~F.arrays_overlap(found, F.array(*[F.lit(t) for t in sorted(self.required[kind])]))

    def _best(self, found: Column, kind: str) -> Column:
        """struct(rank, score, license) of the best template of the kind for a unit's terms, score negated and rounded to 6 places."""
        rows = [(name, weights) for name, k, weights in self.rows if k == kind]
        words = sorted({t for _, weights in rows for t in weights} | set(self.idf))
        # one literal each for what the terms pull and what the templates are
        pulls = {t: {"idf": self.idf[t], "pull": [w.get(t, 0.0) * self.idf[t] for _, w in rows]} for t in words}
        table = F.from_json(F.lit(json.dumps(pulls)), "map<string, struct<idf: double, pull: array<double>>>")
        about = []
        for name, _ in rows:
            groups, others = MARKS.get(name, ((), ()))
            about.append({"rank": 0 if kind == "whole" else 2 if name in LAST else 1, "license": name, "groups": groups, "others": others})
        templates = F.from_json(F.lit(json.dumps(about)), "array<struct<rank: int, license: string, groups: array<array<string>>, others: array<string>>>")

        def fits(t: Column) -> Column:
            return F.forall(t["groups"], lambda g: F.arrays_overlap(found, g)) & ~F.arrays_overlap(found, t["others"])

        def chosen(matches: Column) -> Column:
            best = F.array_min(matches)

            def apart(best: Column) -> Column:
                other = F.array_min(F.filter(matches, lambda m: (m["rank"] == best["rank"]) & (m["license"] != best["license"])))
                return F.when(other.isNull() | (F.round(other["score"] - best["score"], 6) >= MARGIN), best)

            return _let(best, apart)

        def scored(bag: Column) -> Column:
            norm = F.sqrt(F.aggregate(bag, F.lit(0.0), lambda a, b: a + F.pow(b["n"] * F.coalesce(b["e"]["idf"], F.lit(self.unknown)), F.lit(2.0))))
            zeros = F.transform(templates, lambda t: F.lit(0.0))
            dots = F.aggregate(F.filter(bag, lambda b: b["e"].isNotNull()), zeros, lambda a, b: F.zip_with(a, b["e"]["pull"], lambda x, p: x + b["n"] * p))

            def of(norm: Column) -> Column:
                each = F.zip_with(templates, dots, lambda t, d: F.struct(t["rank"].alias("rank"), F.when(norm > 0, -F.round(d / norm, 6)).otherwise(0.0).alias("score"), t["license"].alias("license"), t.alias("about")))
                near = F.filter(each, lambda m: F.when(m["score"] <= -MIN_COSINE, fits(m["about"])).otherwise(False))
                return _let(F.transform(near, lambda m: F.struct(m["rank"].alias("rank"), m["score"].alias("score"), m["license"].alias("license"))), chosen)

            return _let(norm, of)

        looked_up = F.transform(_bag(found), lambda b: F.struct(b["n"].alias("n"), F.try_element_at(table, b["term"]).alias("e")))
        return _let(looked_up, scored)

    def _of_units(self, units: Column, kind: str) -> Column:
        found = F.filter(F.transform(units, _terms), lambda t: ~self._lacks(t, kind))
        return F.array_min(F.array_compact(F.transform(found, lambda t: self._best(t, kind))))

    def own(self, text: Column, is_license_file: Column) -> Column:
        """struct(rank, score, license), score negated, of the text's best match; null without one."""
        lines = F.split(text, "\n")
        paragraphs = F.split(text, PARAGRAPHS)
        sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCES)))
        stop = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT_LINE)), False)
        header = F.array_join(F.slice(lines, 1, F.when(stop > 0, stop - 1).otherwise(F.size(lines)).cast("int")), "\n")
        whole = F.when(F.coalesce(is_license_file, F.lit(False)), F.array(header, text)).otherwise(F.array(header))
        part = self._of_units(F.concat(lines, paragraphs, sentences), "part")
        best = F.array_min(F.array_compact(F.array(self._of_units(whole, "whole"), part)))
        found = _split(text)
        return F.when(~(self._lacks(found, "part") & self._lacks(found, "whole")), best)


def scorer(files: DataFrame, text_col: str, templates: Templates) -> Scorer:
    """idf over all texts; what reaches the driver is one count for each term of the templates."""
    vocabulary = F.array(*[F.lit(t) for t in sorted({t for _, _, text in templates for t in terms(text)})])
    texts = files.where(F.col(text_col).isNotNull()).select(F.array_intersect(_split(F.col(text_col)), vocabulary).alias("t"))
    # the empty term counts the texts
    counts = texts.select(F.explode(F.concat("t", F.array(F.lit("")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    df = {r.t: r.n for r in counts.collect()}
    return Scorer(templates, df, df.pop("", 0))


def _ancestors(directory: Column) -> Column:
    """The directory itself, its parents and the root ''."""
    parts = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, templates: Templates = TEMPLATES, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(doc_id, path, own_license, own_score, license, from_dir): from_dir is null for a license of the file's own."""
    path = F.col(path_col)
    hands_on = F.regexp_extract(path, "[^/]*$", 0).rlike(LICENSE_FILE)
    own = scorer(files, text_col, templates).own(F.col(text_col), hands_on)
    rows = files.select(
        F.col(id_col).alias("doc_id"),
        path.alias("path"),
        F.regexp_extract(path, "^(?:(.*)/)?[^/]*$", 1).alias("dir"),
        hands_on.alias("hands_on"),
        own.alias("own"),
    )
    rows = cut(rows)
    giver = F.min(F.struct("own", "path"))
    givers = rows.where("hands_on and own is not null").groupBy("dir").agg(giver.alias("g")).select(F.col("dir").alias("from_dir"), F.col("g.own.license").alias("handed"))
    near = rows.where("dir is not null").select("dir").distinct().select("dir", F.posexplode(_ancestors(F.col("dir"))).alias("depth", "from_dir"))
    near = near.join(givers, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "handed")).alias("n"))
    # as a table of its own the grouping does not tie the join's partitions, and a full directory can be split
    near = cut(near)
    out = rows.join(near, "dir", "left")
    has = F.col("own").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.col("own.license").alias("own_license"),
        (-F.col("own.score")).alias("own_score"),
        F.coalesce("own.license", "n.handed").alias("license"),
        F.when(~has, F.col("n.from_dir")).alias("from_dir"),
    )
