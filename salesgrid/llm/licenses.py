"""License scans: TF-IDF cosine of license blocks to license texts, then inheritance along directories.

Only DataFrame operations. A text with a trigger word anywhere is cut into candidate blocks: the
whole text, comment blocks, paragraphs, runs of neighbouring paragraphs or lines with license
words, lines and sentences. Templates are full license texts (license_texts/), standard headers
and short notices. Vectors hold term counts times idf, ln((1 + files) / (1 + files with the term))
+ 1, over the whole texts of all files; words of no template weigh as if in no file. Equal blocks
are scored once; their sparse vectors meet those of the templates in a join on the term. A file
whose best block reaches MATCH carries that license itself: texts and headers come before short
notices, and those before Proprietary, whose line also stands in many licenses; then the higher
cosine counts. A file named like LICENSE or COPYING, or one whose words are mostly those of that
block, speaks for its directory; a file without a license of its own takes the one of the nearest
directory above it that has one.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesgrid.llm.common import settle

MATCH = 0.6  # cosine of a notice to its template
MOSTLY = 0.5  # share of a file's words in the matched block that makes it a license file
SHORT = 40  # terms of the longest notice; longer templates are headers and texts
TRIGGER = r"(?i)licen[sc]|copyright|spdx|redistribut|public domain|all rights reserved"
# words of license texts, which bind neighbouring lines and paragraphs together
LEGAL = TRIGGER + r"|permission|permitted|warrant|liab|merchantab|damages|free software|public license|as[ -]is\b|conditions"
COMMENT = r"[ \t]*(?:#|//|/?\*|;|--|%|!|'|\.\.|<!--|(?i:dnl|rem)\b)"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([._-][^/]*)?$"

# fixed values: usual short notices and identifiers, each a vector of its own
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0"),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "ISC": ("Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. See http://www.boost.org/LICENSE_1_0.txt",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
    "Proprietary": ("All rights reserved", "Copyright. All rights reserved."),
}

_GNU = (
    "{program} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as"
    " published by the Free Software Foundation; either version {version} of the License, or (at your option) any later"
    " version. {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
    " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You"
    " should have received a copy of the GNU {name} along with {program}; if not, {where}"
)
_WHERE = (
    "see <https://www.gnu.org/licenses/>.",
    "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
)
HEADERS = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for'
        " the specific language governing permissions and limitations under the License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
} | {
    license: tuple(_GNU.format(program=p, colon=":", name=name, version=version, where=w)
                   for p in ("This program", "This library") for w in _WHERE)
    for license, name, version in (
        ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
        ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
        ("AGPL-3.0", "Affero General Public License", "3"),
    )
}


def full_texts() -> dict[str, tuple[str, ...]]:
    """The license texts of this package by their SPDX names."""
    return {p.stem: (p.read_text(),) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def all_templates() -> dict[str, tuple[str, ...]]:
    """Notices, headers and texts of every license."""
    every = (NOTICES, HEADERS, full_texts())
    return {name: tuple(b for part in every for b in part.get(name, ())) for name in sorted({n for part in every for n in part})}


def _runs(parts: Column, keep, glue: str) -> Column:
    """Neighbouring parts that keep(part before, part, part after) holds, joined."""
    n = F.size(parts)
    none = F.array(F.lit(""))
    trios = F.arrays_zip(
        F.concat(none, parts).alias("before"), parts.alias("part"), F.concat(F.slice(parts, 2, F.greatest(n, F.lit(1))), none).alias("after")
    )
    marked = F.transform(F.slice(trios, 1, n), lambda x: F.when(keep(x), x["part"]).otherwise(F.lit("\x01")))
    return F.split(F.array_join(marked, glue), "\x01")


def _blocks(lines: Column, paragraphs: Column, text: Column) -> Column:
    """The candidate blocks of a text that hold a legal word, each once."""
    legal = lambda x: x.rlike(LEGAL)
    blocks = F.concat(
        F.array(text), paragraphs, lines,
        F.split(text, rf"(?m)^(?!{COMMENT}).*+$"),  # runs of comment lines
        F.split(text, r'/\*|\*/|"{3}|\x27{3}|<!--|-->'),  # between comment signs
        _runs(paragraphs, lambda x: legal(x["part"]), "\n\n"),
        _runs(lines, lambda x: legal(x["part"]), "\n"),
        _runs(lines, lambda x: legal(x["before"]) | legal(x["part"]) | legal(x["after"]), "\n"),
        F.flatten(F.transform(F.filter(lines, legal), lambda x: F.split(x, r"(?<=[.;!?])\s+"))),
    )
    trimmed = F.transform(F.filter(blocks, legal), lambda x: F.regexp_replace(x, r"^[^A-Za-z0-9]++|[^A-Za-z0-9]++$", ""))
    return F.array_distinct(trimmed)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*)"), 1)


def _templates(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    bodies = [(name, body) for name, many in sorted(templates.items()) for body in many]
    rows = spark.createDataFrame([(k, *b) for k, b in enumerate(bodies)], "template int, license string, body string")
    return (
        rows.select("template", "license", F.explode(_terms(F.col("body"))).alias("term"))
        .groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
        .withColumn("rank", F.when(F.col("license") == "Proprietary", 2).when(F.sum("tf").over(_by("template")) <= SHORT, 1).otherwise(0))
    )


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Per file: path, license, score, inherited_from and is_license_file.

    license is the file's own best match (score its cosine), else the
    one inherited from the directory inherited_from, else null. Null texts and empty texts have
    no notice; a null path is alone and inherits nothing; repeated rows give repeated results.
    Other columns are not read.
    """
    spark = files.sparkSession
    rows = settle(
        files.select(
            F.xxhash64(F.monotonically_increasing_id()).alias("row"), F.col(path).alias("path"),
            F.when(F.col(text).rlike(TRIGGER), F.col(text)).alias("text"),
        )
    )
    words = _templates(spark, templates or all_templates())
    vocabulary = words.select("term").distinct()
    n = max(1, rows.count())
    # every distinct block is scored once, however many files hold it
    found = settle(
        rows.where("text is not null")
        .select("row", "text", F.split("text", r"\r\n|\r|\n").alias("lines"))
        .select("row", "text", "lines", F.split(F.array_join("lines", "\n"), r"\n[^A-Za-z0-9\n]*+\n").alias("paragraphs"))
        .select("row", F.size(_terms(F.col("text"))).alias("of"),
                F.explode(_blocks(F.col("lines"), F.col("paragraphs"), F.array_join("lines", "\n"))).alias("body"))
        .select("row", "of", F.md5(F.col("body").cast("binary")).alias("block"), "body")
    )
    held = settle(
        found.groupBy("block").agg(F.any_value("body").alias("body"))
        .select("block", _terms(F.col("body")).alias("terms")).where(F.size("terms") > 0)
        .select("block", F.size("terms").alias("words"), F.explode("terms").alias("term"))
        .groupBy("block", "words", "term").agg(F.count("*").alias("tf"))
    )
    # the tables of template terms, bounded by the templates however many files, are broadcast: no term is a shuffle key
    share = (
        files.select(F.explode(F.array_distinct(_terms(F.col(text)))).alias("term"))
        .join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("files"))
    )
    idf = settle(
        vocabulary.join(share, "term", "left").select(
            "term", (F.log((1.0 + n) / (1.0 + F.coalesce("files", F.lit(0)))) + 1).alias("idf")
        )
    )
    model = words.join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    model = settle(model.withColumn("norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(_by("template")))))
    # terms outside the templates weigh as much as one that no file holds
    weighed = held.join(F.broadcast(idf), "term", "left").withColumn(
        "weight", F.col("tf") * F.coalesce("idf", F.lit(math.log(1.0 + n) + 1))
    )
    sizes = weighed.groupBy("block").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    known = model.select("template", "license", "rank", "term", "norm", F.col("weight").alias("theirs"))
    hits = (
        weighed.join(F.broadcast(known), "term").groupBy("block", "words", "template", "license", "rank")
        .agg(F.sum(F.col("weight") * F.col("theirs")).alias("dot"), F.max("norm").alias("norm"))
        .join(sizes, "block")
        .withColumn("score", F.least(F.lit(1.0), F.round(F.col("dot") / (F.col("length") * F.col("norm")), 9)))
    )
    order = F.struct("rank", (-F.col("score")).alias("minus"), (-F.col("words")).alias("fewer"), "license")
    best = settle(hits.where(F.col("score") >= MATCH).groupBy("block").agg(F.min(order).alias("b")))
    own = found.select("row", "of", "block").join(best, "block").groupBy("row").agg(F.min("b").alias("b"), F.max("of").alias("of")).select(
        F.col("row").alias("hit"), F.col("b.license").alias("own"), (-F.col("b.minus")).alias("score"),
        (-F.col("b.fewer") / F.col("of")).alias("share"),
    )
    marked = settle(
        rows.join(own, rows.row == own.hit, "left").select(
            "row", "path", "own", "score",
            F.coalesce(F.col("own").isNotNull() & (F.col("path").rlike(LICENSE_FILE) | (F.col("share") >= MOSTLY)), F.lit(False))
            .alias("is_license_file"),
        )
    )
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    named = F.col("path").rlike(LICENSE_FILE)
    folders = marked.where("is_license_file and path is not null").select(
        folder.alias("folder"), F.struct((~named).alias("other"), F.col("path").alias("file"), F.col("own").alias("license")).alias("l")
    ).groupBy("folder").agg(F.min("l.license").alias("first"), F.min("l").alias("l"))
    parts = F.split(folder, "/")
    above = marked.where("own is null and path is not null").select(folder.alias("from")).distinct().select(
        "from", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("from", "/"))), lambda k: F.struct(
            k.alias("depth"), F.array_join(F.slice(F.split("from", "/"), 1, k), "/").alias("folder")))).alias("up")
    )
    nearest = (
        above.join(folders, F.col("up.folder") == folders.folder)
        .groupBy("from").agg(F.max(F.struct(F.col("up.depth").alias("depth"), folders.folder.alias("folder"), F.col("l.license").alias("license"))).alias("near"))
    )
    joined = marked.withColumn("from", folder).join(nearest, "from", "left")
    return joined.select(
        "path", F.coalesce("own", "near.license").alias("license"), "score",
        F.when(F.col("own").isNull(), F.col("near.folder")).alias("inherited_from"), "is_license_file",
    )


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Every document as a file <source>/<id / 64>/<id>.txt, with its id.

    A null source is the folder `none`, a row without id the file <source>; an empty table gives no
    rows. Only doc_id, source and text are read, so other columns may have any names.
    """
    file = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 64).cast("string"),
                       F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = scan(docs.select(file.alias("path"), "text"))
    return found.select(
        F.regexp_extract("path", r"(-?\d+)\.txt$", 1).try_cast("long").alias("doc_id"), "path", "license",
        F.round("score", 6).alias("score"), "inherited_from", "is_license_file",
    )
