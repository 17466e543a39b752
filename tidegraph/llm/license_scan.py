"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment decides.

DataFrame operations only. Words are runs of a-z and 0-9 in lower case, shingles are five words. Only shingles that
some template has take part in the sets. A template is cut into pieces no longer than half a window of its scale,
so one window holds each occurrence of a piece whole. Every hash is a band of its own: two sets of similarity j meet
in one of ``BANDS`` bands with probability 1 - (1 - j) ** BANDS, over 0.999 from j = 1/16 on. A window of the
smallest scale holds at most 16 shingles, so a piece of one shingle is met even among 15 foreign ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.workspace import Workspace

WIDTH, PERCENT, BANDS = 5, 80, 128
#: Half the length of a window in words, by scale.
STRIDES = (8, 32, 128)

#: Statements, notices and whole texts of common licences, word for word as their owners publish them.
TEMPLATES = {
    "MIT (statement)": "Released under the MIT License.",
    "MIT (licensed)": "This project is licensed under the MIT License.",
    "Apache-2.0 (statement)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (statement)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (statement)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (statement)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (statement)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0 (notice)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC (notice)": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT (notice)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT (text)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause (text)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause (text)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC (text)": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib (text)": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense (text)": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSL-1.0 (text)": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "GPL-2.0 (notice)": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1 (notice)": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0 (notice)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0 (notice)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "CC0-1.0 (notice)": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(text: str) -> list[str]:
    words = template_words(text)
    return [" ".join(words[k : k + WIDTH]) for k in range(len(words) - WIDTH + 1)]


def marker_words(templates: dict[str, str]) -> list[str]:
    """Words of which every document that holds a template has one.

    Of each template so many shingles contain a marker that the others fall short of ``PERCENT``; so a document
    without markers can't hold it. Each template takes the words that cover most of its open shingles, longer ones first.
    """
    out: list[str] = []
    for text in templates.values():
        own = sorted(set(shingles_of(text)))
        open_ = [s.split() for s in own if not set(s.split()) & set(out)]
        while len(open_) * 100 >= len(own) * PERCENT:
            words = sorted({w for s in open_ for w in s})
            out.append(max(words, key=lambda w: (min(len(w), 6), sum(w in s for s in open_), w)))
            open_ = [s for s in open_ if out[-1] not in s]
    return out


def _pieces(templates: dict[str, str], number: dict[str, int]) -> list[tuple[int, str, list[int]]]:
    """(scale, template, shingle numbers): templates cut in pieces of at most a stride's words, at the smallest scale that fits."""
    out = []
    for name, text in templates.items():
        own = shingles_of(text)
        stride = next((s for s in STRIDES if len(own) + WIDTH - 1 <= s), STRIDES[-1])
        step = stride - WIDTH + 1
        out += [(stride, name, sorted({number[s] for s in own[k : k + step]})) for k in range(0, len(own), step)]
    return out


def _bands(members: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda i: F.array_min(F.transform(members, lambda x: F.xxhash64(x, i))))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, license, n_shared, n_template, containment, first_word, last_word``: a row for each template that a document holds.

    A document holds a template if 100 * shared >= 80 * distinct shingles of the template. Words count from 0; first
    and last are where shared shingles start. A null, empty or short text holds none. Rows that repeat a doc_id count
    as one document, rows without doc_id as well. Texts are scanned whole, however long; templates that tie all count.
    Only the two columns are read. Template texts of fewer than five words are not allowed.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "licenses")
    own = {name: sorted(set(shingles_of(text))) for name, text in templates.items()}
    if not all(own.values()):
        raise ValueError("a template has fewer than five words")
    number = {s: k for k, s in enumerate(sorted({s for x in own.values() for s in x}))}
    # the tables of templates are constants, so they may be broadcast
    universe = F.broadcast(spark.createDataFrame(list(number.items()), "shingle string, sid int"))
    holds = F.broadcast(spark.createDataFrame([(number[s], name, len(x)) for name, x in own.items() for s in x], "sid int, license string, n_template long"))
    pieces = spark.createDataFrame(_pieces(templates, number), "stride int, license string, members array<int>")

    lower = F.lower("text")
    marked = F.lit(False)
    for word in marker_words(templates):
        marked = marked | F.contains(lower, F.lit(word))
    words = F.split(F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " ")), " ")
    worded = docs.where(marked).select("doc_id", words.alias("w")).where(F.size("w") >= WIDTH)
    shingle = F.transform(F.sequence(F.lit(1), F.size("w") - WIDTH + 1), lambda k: F.array_join(F.slice("w", k, WIDTH), " "))
    hits = space.keep(worded.select("doc_id", F.posexplode(shingle).alias("pos", "shingle")).join(universe, "shingle").select("doc_id", "pos", "sid"), "hits")

    scaled = hits.select("doc_id", "pos", "sid", F.explode(F.array(*[F.lit(s) for s in STRIDES])).alias("stride"))
    at = F.floor(F.col("pos") / F.col("stride"))
    windows = scaled.select("doc_id", "sid", "stride", F.explode(F.array(at, at - 1)).alias("window")).groupBy("doc_id", "stride", "window").agg(F.sort_array(F.collect_set("sid")).alias("members"))
    windows = windows.select("doc_id", "stride", "members").distinct()
    sets = windows.select("stride", "members").distinct().select("stride", "members", F.posexplode(_bands(F.col("members"))).alias("band", "least"))
    keys = F.broadcast(pieces.select("stride", "license", F.posexplode(_bands(F.col("members"))).alias("band", "least")))
    met = sets.join(keys, ["stride", "band", "least"]).select("stride", "members", "license").distinct()
    candidates = windows.join(met, ["stride", "members"]).select("doc_id", "license").distinct()

    # exact shingle containment, of the retrieved pairs only
    seen = hits.join(candidates, "doc_id").join(holds, ["license", "sid"]).groupBy("doc_id", "license", "n_template").agg(F.countDistinct("sid").alias("n_shared"), F.min("pos").cast("long").alias("first_word"), F.max("pos").cast("long").alias("last_word"))
    exact = seen.where(F.col("n_shared") * 100 >= F.col("n_template") * PERCENT)
    return exact.select("doc_id", "license", "n_shared", "n_template", (F.col("n_shared") / F.col("n_template")).alias("containment"), "first_word", "last_word")


def scan_licenses_sql(templates: dict[str, str] = TEMPLATES) -> str:
    """The same rows in SQL, by comparing every shingle."""
    values = ", ".join("('{}', '{}')".format(name.replace("'", "''"), " ".join(template_words(text))) for name, text in templates.items())
    return f"""
WITH templates(license, words) AS (SELECT license, string_split(txt, ' ') FROM (VALUES {values}) AS t(license, txt)),
held AS (SELECT DISTINCT license, array_to_string(words[k:k + {WIDTH - 1}], ' ') AS shingle
         FROM (SELECT license, words, unnest(range(1, len(words) - {WIDTH - 2})) AS k FROM templates)),
sized AS (SELECT license, count(*) AS n_template FROM held GROUP BY license),
worded AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, words, unnest(range(1, len(words) - {WIDTH - 2})) AS k FROM worded WHERE len(words) >= {WIDTH}),
hits AS (SELECT doc_id, k - 1 AS pos, array_to_string(words[k:k + {WIDTH - 1}], ' ') AS shingle FROM numbered)
SELECT doc_id, license, count(DISTINCT shingle) AS n_shared, n_template,
       CAST(count(DISTINCT shingle) AS DOUBLE) / n_template AS containment, min(pos) AS first_word, max(pos) AS last_word
FROM hits JOIN held USING (shingle) JOIN sized USING (license)
GROUP BY doc_id, license, n_template
HAVING count(DISTINCT shingle) * 100 >= n_template * {PERCENT}"""
