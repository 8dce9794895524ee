"""Segments, transport streams, licences, the mix's schedule and shards, each against a plain form of the same thing."""

import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import base, licenses, mixing, sharding, toxicity, transport
from touchline.llm.base import table
from touchline.llm.queries import QUERIES


def maximal(scores, at=0):
    """All maximal-scoring segments by their definition: the best segment, then the same to its left and right."""
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return maximal(scores[:i], at) + [(best[0], at + i, at + j)] + maximal(scores[j:], at + j)


def test_segments_as_defined():
    r = random.Random(4)
    for _ in range(150):
        scores = [r.gauss(-0.2, 1) for _ in range(r.randrange(0, 26))]
        got, want = toxicity.segments(scores), maximal(scores)
        assert [x[1:] for x in got] == [x[1:] for x in want]
        assert np.allclose([x[0] for x in got], [x[0] for x in want])


def test_segments_are_linear():
    r = random.Random(4)
    assert toxicity.segments([r.gauss(0, 1) for _ in range(300_000)])
    assert len(toxicity.segments([1.0, -2.0] * 100_000)) == 100_000


def test_toxicity_without_a_toxic_label(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i}") for i in range(30)] + [(30, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    assert all(x.score < 0.5 and x.predicted == 0 for x in toxicity.classify(docs, labels).collect())


def test_very_toxic_long_documents_keep_scores_finite():
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(toxicity.MAP, bool), 1.0, 1e-3, 1.5, (0.0, 0.0))
    x = toxicity._features(model, np.array([10, 2_000_000, 0]), [[1.5], [1.5] + [5000.0] * 400, []])
    assert np.isfinite(x).all() and x[1, 1] > x[0, 1] > x[2, 1] == 0
    r = np.random.default_rng(1)
    y = (r.random(4000) < 0.1).astype(float)
    x = np.stack([np.ones(4000), np.where(y > 0, r.exponential(4, 4000), r.exponential(0.3, 4000))], 1)
    x[np.flatnonzero(y)[:5], 1] = 1400  # some far out
    a, b = toxicity._logistic(x, y)
    assert np.isfinite([a, b]).all() and a < 0 < b


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 40_000])
def test_streams_round_trip(n):
    text = "".join(random.Random(n).choice("aé漢 \n") for _ in range(n))[: n or None] if n else None
    payload = transport.payload_of(text)
    media = transport.write_stream(payload)
    read = transport.read_stream(media)
    assert read.data[transport.DATA_PID] == payload and len(payload) % 576 == 0 and payload
    assert read.counter_errors == 0 and read.programs == {1: transport.PMT_PID} and read.kinds == {transport.DATA_PID: 6}
    units = len(payload) // 576
    assert read.pts[transport.DATA_PID].tolist() == [i * transport.TICKS for i in range(units)]
    assert np.flatnonzero(read.access[transport.DATA_PID]).tolist() == list(range(0, units, transport.RANDOM_ACCESS))


def test_broken_streams_are_told():
    media = transport.write_stream(transport.payload_of("some text " * 500))
    with pytest.raises(ValueError, match="isn't whole"):
        transport.read_stream(media[: 188 * 4] + media[188 * 5 :])
    unit = 188 * 4
    assert transport.read_stream(media[: 188 * 2 + unit] + media[188 * 2 + unit * 2 :]).counter_errors == 1  # a whole unit is gone
    assert transport.read_stream(media[: 188 * 2 + unit] + media[188 * 2 + unit * 5 :]).counter_errors == 0  # 16 packets: the counter cannot tell, time stamps do
    moved = bytearray(media)
    moved[188 * 3 + 3] ^= 1
    assert transport.read_stream(bytes(moved)).counter_errors > 0
    bad = bytearray(media)
    bad[10] ^= 1
    with pytest.raises(ValueError, match="CRC"):
        transport.read_stream(bytes(bad))
    with pytest.raises(ValueError, match="whole transport packets"):
        transport.read_stream(media[:-1])


def test_media_digests(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "ä" * 288), (4, "x" * 577)], "doc_id long, text string")
    got = {r.doc_id: r for r in transport.read_media(transport.to_media(docs)).collect()}
    assert [got[i].n_bytes for i in (1, 2, 3, 4)] == [0, 0, 576, 577] and [got[i].payload_bytes for i in (1, 2, 3, 4)] == [576, 576, 576, 1152]
    assert got[1].media_sha256 == got[2].media_sha256 and got[4].tail_crc32 == zlib.crc32(b"\xff" * 32)


def test_licences_and_inheritance(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][0]
    rows = [
        (1, "p/LICENSE", f"Some project\n{mit}\n"),
        (2, "p/a/b/x.py", "print(1)"),
        (3, "p/a/COPYING.txt", gpl.upper()),
        (4, "p/a/c/y.py", "nothing here"),
        (5, "q/z.py", "the license of this is unknown, as it is not under any that we know of"),
        (6, "p/own.py", f"# {licenses.TEMPLATES['Apache-2.0'][0]}"),
        (7, None, mit),
        (8, "p/a/none.py", None),
        (9, "pp/x.py", ""),
    ]
    rows += [(100 + i, f"q/f{i}.txt", f"filler text {i} with words of its own") for i in range(200)]
    got = {r.file_id: (r.own, r.license, r.license_from) for r in licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "MIT", "file") and got[3] == ("GPL-3.0", "GPL-3.0", "file") and got[6][0] == "Apache-2.0" and got[7] == ("MIT", "MIT", "file")
    assert got[2] == (None, "GPL-3.0", "p/a") and got[4] == (None, "GPL-3.0", "p/a") and got[8] == (None, "GPL-3.0", "p/a")
    assert got[5] == got[9] == (None, None, None) and len(got) == len(rows)


def test_wrapped_headers_and_whole_licence_texts(spark):
    wrap = lambda text, mark: "\n".join(mark + line for line in textwrap.wrap(" ".join(text.split()), 60))
    rows = [(i, f"h{i}/a.py", "import x\n" + wrap(texts[-1], "# ") + "\nprint(1)", name) for i, (name, texts) in enumerate(licenses.TEMPLATES.items())]
    rows += [(i, f"h{i}/LICENSE", "Copyright 2020 someone\n\n" + wrap(texts[-1], "").upper(), name) for i, (name, texts) in enumerate(licenses.TEMPLATES.items(), 50)]
    rows += [(7, "other/place", "the same id with another text", None)]
    filler = spark.range(1000, 2000).select(F.col("id").alias("file_id"), F.concat(F.lit("x/f"), "id").alias("path"), F.concat(F.lit("the file of the work by "), F.col("id").cast("string")).alias("text"))
    got = licenses.scan(spark.createDataFrame([r[:3] for r in rows], "file_id long, path string, text string").unionByName(filler)).where("file_id < 1000").collect()
    assert sorted((r.file_id, r.path, r.own or "") for r in got) == sorted((i, p, own or "") for i, p, _, own in rows)


def test_query_inherits(spark):
    """Directories of op4's tree are shared and nested, and what files inherit is what their nearest licence file declares."""
    got = QUERIES["op4_licenses"](spark, "/root/testdata/sf0.1").collect()
    given = {}
    for r in sorted(got, key=lambda r: r.path, reverse=True):
        folder, name = r.path.rsplit("/", 1)
        if r.own and name.split(".")[0] in ("LICENSE", "COPYING"):
            given[folder] = r.own
    inherited = 0
    for r in got:
        up = [r.path.rsplit("/", k)[0] for k in range(1, 4)]
        want = (r.own, "file") if r.own else next(((given[f], f) for f in up if f in given), (None, None))
        assert (r.license, r.license_from) == want
        inherited += want[0] is not None and not r.own
    assert inherited > 500


@pytest.mark.parametrize("n", [200, 2000])
def test_licences_among_other_words(spark, n):
    apache, mit = "Apache-2.0", "MIT"
    rows = [
        (1, "Copyright 2020 Acme. Released under the MIT License.", mit),
        (2, "# Released under the MIT License by Acme", mit),
        (3, 'Copyright (c) 2021 Foo Inc. Licensed under the Apache License, Version 2.0 (the "License");', apache),
        (4, "// Copyright (c) 2021 Foo Inc.\n// Licensed under the Apache\n// License, Version 2.0 (the License)\nint x;", apache),
        (5, licenses.TEMPLATES["MIT"][1] + " and associated documentation files, to deal in the software without restriction", "MIT"),
        (6, "she was released under the bridge with a license to fish", None),
        (7, "the terms of this work and of the library are in the file", None),
    ]
    filler = spark.range(100, 100 + n).select(F.col("id").alias("file_id"), F.concat(F.lit("x/f"), "id").alias("path"), F.concat(F.lit("the file of the work by "), F.col("id").cast("string")).alias("text"))
    files = spark.createDataFrame([(i, f"d{i}/a", t) for i, t, _ in rows], "file_id long, path string, text string").unionByName(filler)
    got = {r.file_id: r.own for r in licenses.scan(files).where("file_id < 100 or own is not null").collect()}
    assert got == {i: own for i, _, own in rows}


FAMILIES = [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]


@pytest.mark.parametrize("n", [100, 1500])
def test_families_are_told_apart_by_their_words(spark, n):
    """Published headers and texts, each in a file of its own, against cosines of all lines and windows by plain counting."""
    files = [(i, f"d{i}/x.py", f"Copyright 2020 Some One\n# " + "\n# ".join(textwrap.wrap(text, 70)) + "\nimport os") for i, (_, text) in enumerate(FAMILIES)]
    files += [(100 + i, f"x/f{i}", f"the file of the work by {i} and of the library it is under") for i in range(n)]
    got = {r.file_id: (r.own, r.own_cosine) for r in licenses.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert [got[i][0] for i in range(len(FAMILIES))] == [name for name, _ in FAMILIES]
    assert all(got[100 + i][0] is None for i in range(n))
    words = lambda text: re.findall(licenses.WORD, text.lower())
    seen = Counter(w for _, _, text in files for w in set(words(text)))
    weigh = lambda ws: {w: c * math.log((1 + len(files)) / (1 + seen[w])) for w, c in Counter(ws).items()}
    dot = lambda a, b: sum(x * b.get(w, 0.0) for w, x in a.items())
    templates = [(name, len(words(t)), weigh(words(t))) for name, ts in licenses.TEMPLATES.items() for t in ts]
    for i in range(len(FAMILIES)):
        ws, best = words(files[i][2]), []
        for name, size, t in templates:
            for c in [ws[k : k + size] for k in range(max(len(ws) - size, 0) + 1)] + [words(line) for line in files[i][2].split("\n")]:
                c = weigh(c)
                cosine = dot(c, t) / max(math.sqrt(dot(c, c) * dot(t, t)), 1e-12)
                if round(cosine, 6) >= licenses.COSINE:
                    best.append((round(3 * dot(c, t) - dot(c, c) - dot(t, t), 4), name, cosine))
        told, name, cosine = max(best)
        assert got[i][0] == name and abs(got[i][1] - max(c for x, m, c in best if x == told and m == name)) < 2e-5


def test_schedule_gives_each_block_once_and_evenly(spark):
    blocks = [700, 0, 40, 1300, 3]
    rows = [(i, n, sum(blocks[:i])) for i, n in enumerate(blocks)]
    got = mixing.schedule(spark.createDataFrame(rows, "sid int, blocks long, from long")).orderBy("slot").collect()
    assert sorted((r.sid, r.block) for r in got) == [(i, b) for i, n in enumerate(blocks) for b in range(n)]
    assert len({r.slot for r in got}) == len(got)
    seen = [0] * len(blocks)
    for k, r in enumerate(got, 1):
        seen[r.sid] += 1
        assert all(abs(s - k * n / sum(blocks)) < 12 for s, n in zip(seen, blocks, strict=True))  # every beginning of the mix has the weights


def test_mixed_texts_hold_what_is_taken(spark, odd_folder):
    docs = mixing.stage(spark.read.parquet(f"{odd_folder}/documents.parquet"), "odd")
    took = {r.doc_id: r.n for r in mixing.taken(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    got = mixing.mixed(docs)
    assert got.columns == [*docs.columns, "mix_slot"]
    n = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert n == {d: k for d, k in took.items() if k}
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    cuts = [(r.doc_id, r.text) for r in got.collect() if (r.doc_id, r.text) not in whole]
    assert len(cuts) <= docs.select("source").distinct().count()  # only what reaches a source's target is cut, and only at its end
    assert all(any(d == i and t.startswith(x) for i, t in whole if t) for d, x in cuts)


def test_slots_keep_the_order_of_the_mix_across_a_write(spark, tmp_path):
    """Written by the pipeline's own steps and read in whatever order files come: the slot tells the mix, whose beginnings are near the targets."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    targets = {r.source: r.target for r in mixing.taken(docs).join(docs.select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect()}
    words, seen, total = 0, dict.fromkeys(targets, 0), sum(targets.values())
    mixing.mixed(docs).repartition(7).write.parquet(str(tmp_path / "mix"))
    rows = spark.read.parquet(str(tmp_path / "mix")).select("mix_slot", "source", mixing.n_words(F.col("text")).alias("n")).collect()
    for r in sorted(rows, key=lambda r: r.mix_slot):
        seen[r.source] += r.n
        words += r.n
        if words > total / 4:  # a document's words count where it begins, so the very beginning is coarser
            assert all(abs(seen[k] / words - t / total) < 0.08 for k, t in targets.items())


def test_slot_of_documents_that_have_one(spark):
    docs = spark.createDataFrame([(i, f"a b c {i}", "s", "mine", i) for i in range(20)] + [(None, "x y", None, "mine", 3)], "doc_id long, text string, source string, mix_slot string, N_words int")
    got = mixing.mixed(docs)
    assert got.columns == [*docs.columns, "mix_slot_"] and {r.mix_slot for r in got.collect()} == {"mine"}
    assert "n_chars" not in got.columns and got.where("mix_slot_ is null").count() == 0


def test_schedule_decides_the_order(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    first = lambda: sorted((r.doc_id, r.first_slot) for r in mixing.taken(docs).collect() if r.taken)
    before = first()
    monkeypatch.setattr(mixing, "STEP", 1)
    assert first() != before


def test_shards_are_even_and_gapless(spark):
    r = random.Random(6)
    rows = [(i // 2, "x" * r.randrange(0, 300)) for i in range(3000)] + [(7, "same")] * 500 + [(8, None)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    total, most = sum(x["size"] for x in got), max(x["size"] for x in got)
    for s in range(40):
        own = [x for x in got if x.shard == s]
        assert sorted(x.slot for x in own) == list(range(len(own)))
        assert abs(sum(x["size"] for x in own) - total / 40) <= most
    order = sorted(got, key=lambda x: (x.doc_id, x.text_crc32, x["size"]))
    assert [x.shard for x in order] == sorted(x.shard for x in got)


@pytest.mark.parametrize("shape", ["none", "loops", "chain", "star", "random"])
def test_components(spark, shape):
    r = random.Random(3)
    edges = {
        "none": [],
        "loops": [(4, 4), (5, 5)],
        "chain": [(i, i + 1) for i in range(-40, 60)],
        "star": [(7, i) for i in range(300)] + [(-3, 299), (-3, 299)],
        "random": [(r.randrange(-400, 400) * 10**15, r.randrange(-400, 400) * 10**15) for _ in range(350)],
    }[shape]
    low = {x: x for e in edges for x in e}
    while any(low[a] != low[b] for a, b in edges):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    want = sorted((x, c) for x, c in low.items() if any(x in e and e[0] != e[1] for e in edges))
    got = base.components(spark.createDataFrame(edges, "a long, b long").repartition(5))
    assert sorted(map(tuple, got.collect())) == want
