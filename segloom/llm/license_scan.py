"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are runs of letters and digits, lower-cased; shingles are two words. A template is cut into pieces of PIECE
shingles, a document into windows of 2 * PIECE shingles, PIECE apart, so that every run of PIECE + 1 shingles lies
whole in a window. A window with all of a piece of n shingles agrees with it in one band, of one minimum each, with
probability n / (2 * PIECE): in none of BANDS bands for less than one case in a thousand at MIN_PIECE shingles, and a
template of several pieces has as many chances. A document's bands are hash-joined with those of the pieces. A window
that meets a piece says where the template would begin; the passage there, as long as the template and SLACK percent
more, is compared with the template, shingle by shingle. A template is found if one passage contains MIN_CONTAINED of its
distinct shingles; what other passages hold doesn't count.

All of it is SQL. Bands are made only for windows that hold a key of some piece, as no other can meet one.

Defined cases: a null or short text has no license; several templates may be found in one document, and a row is
given for each; templates of fewer than MIN_PIECE shingles are refused; documents are told apart by id and text, so
repeated rows give one result and null ids do no harm; empty tables give no rows; other columns don't matter. A text
of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, let, read, small_enough, text_or_empty

PIECE, MIN_PIECE, BANDS, MIN_CONTAINED, SLACK = 5, 4, 14, 0.9, 25
#: Rows of pieces that are broadcast, and the shingles of their templates, 8 bytes each; distinct keys of pieces that are
#: listed in the plan.
BROADCAST_PIECES, BROADCAST_SHINGLES, LISTED_KEYS = 100_000, 8_000_000, 10_000

# Notices as licenses word them, then whole licenses without their copyright lines.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT-notice", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib-text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0-text", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense-text", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("GPL-header-text", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("MPL-2.0-header-text", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]


def shingles(text: Column) -> Column:
    """Hashes of each two neighbouring words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<bigint>"))
    return let(words, pairs)


def _salt(band: int) -> Column:
    # the fractional part of multiples of the golden ratio, in 64 bits: differs in all digits from band to band
    salt = (band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return F.lit(salt - (1 << 64) if salt >> 63 else salt)


def minima(hashes: Column) -> Column:
    """A struct with, for each band, the hash that comes first in the band's order."""
    names = [f"m{k}" for k in range(BANDS)]
    first = lambda h: [h.bitwiseXOR(_salt(k)) for k in range(BANDS)]
    start = F.struct(*[F.lit((1 << 63) - 1).alias(m) for m in names])
    return F.aggregate(hashes, start, lambda have, h: F.struct(*[F.least(have[m], x).alias(m) for m, x in zip(names, first(h), strict=True)]))


def pieces(templates: DataFrame) -> DataFrame:
    """band, key, license, piece_at, n, whole: a row for each band of each piece, which begins at shingle ``piece_at`` of ``n``.

    ``whole`` has the template's distinct shingles.
    """
    hashed = templates.select("license", shingles(F.col("text")).alias("h"))
    if few := [r["license"] for r in hashed.where(F.size("h") < MIN_PIECE).select("license").limit(10).collect()]:
        raise ValueError(f"templates are too short: {few}")
    # the last piece ends with the template
    last = F.greatest(F.size("h") - PIECE, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(PIECE)), F.array(last)))
    cut = hashed.select("license", F.size("h").alias("n"), F.array_distinct("h").alias("whole"), F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("h", i + 1, PIECE).alias("h")))).alias("piece"))
    bands = F.posexplode(F.array(*[F.col(f"m.m{k}") for k in range(BANDS)])).alias("band", "key")
    return cut.withColumn("m", minima(F.col("piece.h"))).select("license", "n", "whole", F.col("piece.at").alias("piece_at"), bands).distinct()


def find_licenses(docs: DataFrame, templates: DataFrame, min_contained: float = MIN_CONTAINED) -> DataFrame:
    """doc_id, license, contained, first_shingle: the templates in each document, with the best passage of each."""
    cut = checkpoint(pieces(templates))
    rows, carried = cut.agg(F.count("*"), F.sum(F.size("whole"))).first()
    few = rows <= BROADCAST_PIECES and (carried or 0) <= BROADCAST_SHINGLES
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_a"), F.xxhash64("text", F.lit(1)).alias("text_b"), shingles(text_or_empty()).alias("h"))
    me = ["doc_id", "text_a", "text_b"]
    bands = F.posexplode(F.array(*[F.col(f"m.m{k}") for k in range(BANDS)])).alias("band", "key")
    window = minima(F.slice("h", F.col("at") * PIECE + 1, 2 * PIECE))
    keyed = hashed.select(*me, "h", F.explode(_places(cut)).alias("at")).withColumn("m", window).select(*me, "h", "at", bands)
    if few:  # shingles go along by reference
        met = keyed.join(F.broadcast(cut), ["band", "key"])
    else:  # keys and places are shuffled; then the shingles of the documents that meet a piece
        named = keyed.select(*me, "at", "band", "key").join(cut, ["band", "key"]).select(*[F.col(c).alias(f"m_{c}") for c in me], "at", "license", "n", "whole", "piece_at")
        same = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("text_a") == F.col("m_text_a")) & (F.col("text_b") == F.col("m_text_b"))
        met = hashed.dropDuplicates(me).join(named, same)
    # where the template would begin, as the number of a block of PIECE shingles; the passage begins a block before
    block = F.greatest(F.col("at") - F.floor(F.col("piece_at") / PIECE) - 1, F.lit(0)).cast("int")
    passage = F.slice("h", F.col("block") * PIECE + 1, F.col("n") + 3 * PIECE + F.ceil(F.col("n") * SLACK / 100).cast("int"))
    shared = F.size(F.array_intersect(F.col("whole"), passage)) / F.size("whole")
    each = met.withColumn("block", block).select(*me, "license", shared.alias("contained"), "block").where(F.col("contained") >= min_contained)
    best = F.max_by(F.struct("contained", "block"), F.struct("contained", -F.col("block"))).alias("best")
    return each.groupBy(*me, "license").agg(best).select("doc_id", "license", "best.contained", (F.col("best.block") * PIECE).cast("long").alias("first_shingle"))


def _places(cut: DataFrame) -> Column:
    """The numbers of the windows whose bands are to be compared: those with a shingle that gives a key of ``cut``.

    A band's key comes from one of the window's own shingles, so no other window can meet a piece. Beyond LISTED_KEYS keys
    it is all windows.
    """
    blocks = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.floor((F.size("h") - 1) / PIECE).cast("int"))).otherwise(F.array().cast("array<int>"))
    salts = F.array(*[_salt(k) for k in range(BANDS)])
    keys = cut.select(F.col("key").bitwiseXOR(F.get(salts, F.col("band"))).alias("key")).distinct()
    if not small_enough(keys, LISTED_KEYS):
        return blocks
    listed = [r["key"] for r in keys.collect()]
    at = F.filter(F.transform("h", lambda x, i: F.when(x.isin(listed), F.floor(i / PIECE).cast("int"))), lambda i: i.isNotNull())
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(at), lambda i: F.when(i > 0, F.array(i - 1, i)).otherwise(F.array(i)))))


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and license notice in it."""
    return find_licenses(read(spark, sf_dir, "documents"), templates(spark))
