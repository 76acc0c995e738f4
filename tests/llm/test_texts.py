"""Quality, toxicity, licenses and benchmark leaks: held-out accuracy and planted cases."""

from __future__ import annotations

import random
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from postroom.llm import latent, licenses, queries, quality, toxicity
from postroom.llm.common import buffer_of, noted
from tests.llm.conftest import AWKWARD, DOCS

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def ranking(rows, truth):
    """Share of pairs of a one and a zero that the scores put in order, over held-out rows."""
    pairs = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    ones, zeros = ([s for s, t in pairs if t == want] for want in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize(
    "query, label, threshold, least, sf, size",
    [(queries.op1_quality, "quality", 0.3, 0.98, SF, 1_000), (queries.op3_toxicity, "toxic", 0.5, 0.97, LARGER, 10_000)],
)
def test_held_out_accuracy(spark, query, label, threshold, least, sf, size):
    rows = query(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    marked = spark.read.parquet(f"{sf}/labels.parquet").join(docs, "doc_id").collect()
    truth = {r.doc_id: r[label] for r in marked}
    assert len(rows) == size
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= threshold) for r in rows)
    assert ranking(rows, truth) >= least
    if label == "toxic":
        # Each language by itself; the least has six toxic documents here.
        for lang in {r.lang for r in marked}:
            mine = {r.doc_id: r.toxic for r in marked if r.lang == lang}
            found = {t: [r.predicted for r in rows if r.held_out and mine.get(r.doc_id) == t] for t in (0, 1)}
            assert np.mean(found[1]) >= 0.8 and np.mean(found[0]) <= 0.03, lang
            assert ranking(rows, mine) >= 0.97, lang


def test_scores_of_awkward_rows(awkward, empty, labels, no_labels):
    for scores, name in ((quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")):
        rows = scores(awkward, labels).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in AWKWARD)
        assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
        assert scores(empty, labels).collect() == []
        assert {r.score for r in scores(awkward, no_labels).collect()} == {0.5}


def test_labels_of_the_held_out_fold_are_never_read(spark, small, labels):
    from pyspark.sql import functions as F

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.quality_scores(small, x).collect())) for x in (labels, turned))
    assert a == b


def test_features_do_not_depend_on_neighbours():
    texts = ["", "a b a b a b", "Ende. Ende.", "x", "äöü ß"]
    parts = np.random.default_rng(0).normal(size=quality.BUCKETS + 1).astype(np.float32)
    parts[-1] = 0
    together = quality.logits(parts, 0.25, *quality.buffer_of(pa.array(texts)))
    alone = [quality.logits(parts, 0.25, *quality.buffer_of(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-4) and alone[0] == 0.25


def test_a_text_in_runs_has_the_features_of_the_whole():
    rng = np.random.default_rng(3)
    parts = rng.normal(size=quality.BUCKETS + 1).astype(np.float32)
    parts[-1] = 0
    text = ["one two two. ", "Drei drei drei drei\n\n", "x" * 50 + " ", "é, ß  \t"]
    for size, start in ((400, ""), (60, "  "), (3, ""), (1, " ")):
        buffer = np.frombuffer((start + "".join(rng.choice(text) for _ in range(size))).encode(), np.uint8)
        whole = quality.logits(parts, 0.25, buffer, np.array([0, len(buffer)]))[0]
        for run in (1, 7, 30, 1_000, 10**6):
            assert abs(quality.long_logit(parts, 0.25, buffer, run) - whole) < 1e-6
    assert quality.long_logit(parts, 0.25, np.zeros(0, np.uint8)) == 0.25


def test_a_text_of_nine_megabytes_scores_as_in_one_pass():
    rng = np.random.default_rng(4)
    parts = rng.normal(size=quality.BUCKETS + 1).astype(np.float32)
    parts[-1] = 0
    words = np.array([f"w{i}" for i in range(5_000)])
    text = " ".join([*rng.choice(words[:2_500], 900_000), *rng.choice(words[2_500:], 900_000)])
    buffer = np.frombuffer(text.encode(), np.uint8)
    assert len(buffer) > 9_000_000
    whole = quality.logits(parts, 0, buffer, np.array([0, len(buffer)]))[0]
    assert abs(quality.long_logit(parts, 0, buffer) - whole) < 1e-6


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.character_model(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize(
    "written",
    ["1d1ot", "i d i o t", "idiooot", "!diot", "i.d.i.o.t", "IDIOT", "1D10T", "i-d-1-o-t", "idio+", "i  d  i  o  t", "1d10+"],
)
def test_disguised_words_are_restored(model, written):
    restored = toxicity.restorer(model)(f"that {written}, there")
    assert restored.lower() == "that idiot, there"


@pytest.mark.parametrize("written", ["a$$", "sh1+", "idio+", "m€rde", "merd€", "i  d  i  o  t", "a s s", "x - y . z"])
def test_signs_of_disguise_are_seen_anywhere_in_a_word(written):
    for text in (written, f"that {written} there", f"é{written}"[1:]):
        assert toxicity.disguised(np.frombuffer(text.encode(), np.uint8)).any()


def test_usual_signs_are_no_disguise():
    for text in ("What a day! It cost 5 € or 3%; see B2, no. 17 (a, b) | end!", "x - y", "5$ - 100€", "", "a"):
        marks = toxicity.disguised(np.frombuffer(text.encode(), np.uint8))
        assert not marks.any() or text.startswith("5$")


def test_clean_text_stays(model):
    text = "Then it was on 3 of 12 days; a b or 100% and\n\nthat's it -- well."
    assert toxicity.restorer(model)(text) == text


def test_decoding_finds_the_cheapest_path(model):
    """Against every path through the lattice."""
    for segment in ("m0r0n", "l0$er", "s c u m", "aaa1"):
        paths = [("", 0.0)]
        for options in toxicity._lattice(segment):
            paths = [(p + letter, cost + extra) for p, cost in paths for letter, extra in options]

        def cost(path):
            codes = [0, 0, *(toxicity._code(c) for c in path[0]), 0]
            return path[1] + sum(float(model[codes[i], codes[i + 1], codes[i + 2]]) for i in range(len(codes) - 2))

        assert toxicity.decode(segment, model) == min(paths, key=cost)[0].strip()


def test_license_notices(spark, awkward, empty):
    mit = licenses.TEMPLATES["MIT"].replace(". ", ".\n").replace("to use, ", "to use,\n")
    texts = [
        "Some prose here.\nLicensed under CC BY-NC 4.0.\nMore prose.",
        f"# Copyright (c) 2020 Someone\n{mit}\n\nint main",
        "This work is licensed under the GNU General Public License, version 2.",
        "He had a license to do as is right, under conditions.",
        "All rights reserved.\n\n\n\nReleased under the MIT License.",
        "word " * 400 + "Licensed under the Apache License, Version 2.0. " + "word " * 400,
        None,
    ]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    found = defaultdict(list)
    for r in licenses.license_notices(docs).collect():
        found[r.doc_id].append(r.license)
        assert 0 <= r.start <= r.start + r.length <= len(texts[r.doc_id])
    assert dict(found) == {
        0: ["CC-BY-NC-4.0"], 1: ["MIT"], 2: ["GPL-2.0-notice"],
        4: ["All-rights-reserved", "MIT-notice"], 5: ["Apache-2.0-notice"],
    }
    assert licenses.license_notices(awkward).collect() == []
    assert licenses.license_notices(empty).collect() == []


# Endings and openings of licences as published, around the wordings looked for.
PUBLISHED = {
    "MIT": (
        "MIT License\n\nCopyright (c) 2020 Some Body\n\n{}",
        " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER"
        " IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE"
        " OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Copyright (c) 2004 by Some Body\n\n{}",
        ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "BSD-2-Clause": (
        "Copyright (c) 1999, Some Body\n\n{}",
        ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED'
        " WARRANTIES ARE DISCLAIMED.",
    ),
    "GPL-3.0-or-later": (
        "A program that does things.\nCopyright (C) 2007  Some Body\n\n{}",
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "Apache-2.0": ("Copyright 2011 Some Body\n\n{}", " See the License for the specific language governing permissions."),
}


@pytest.mark.parametrize("columns", [60, 72, 80])
@pytest.mark.parametrize("prefix", ["", " * ", "# "])
def test_licences_as_published(spark, columns, prefix):
    rows = []
    for i, (name, (around, end)) in enumerate(PUBLISHED.items()):
        wording = licenses.TEMPLATES[name]
        wording = wording.replace("conditions: ", "conditions:\n\n").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
        wording = wording.replace("met: ", "met:\n\n1. ").replace(" Redistributions in", "\n\n2. Redistributions in")
        body = around.format(wording + end)
        lines = [line for part in body.split("\n") for line in (textwrap.wrap(part, columns) or [""])]
        rows.append((i, "\n".join(prefix + line for line in lines)))
    found = licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.license) for r in found}
    assert got == {(i, name) for i, name in enumerate(PUBLISHED)}
    for r in found:
        text = rows[r.doc_id][1][r.start : r.start + r.length]
        first, last = (licenses.plain_words(licenses.TEMPLATES[r.license])[k] for k in (0, -1))
        assert text.lower().startswith(first) and text.lower().endswith(last)


def test_notices_beside_other_words_and_notices(spark):
    prose = "Some words of a kind that has nothing to do with it, and more of them, "
    texts = {
        f"{prose * 2}Released under the MIT License. {prose}": ["MIT-notice"],
        f"{prose * 9}\nCopyright 2020 Some Body. All rights reserved. {prose * 9}": ["All-rights-reserved"],
        "Released under the MIT License.\nLicensed under CC BY 4.0.": ["CC-BY-4.0", "MIT-notice"],
        "Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0. All rights reserved.": ["All-rights-reserved", "CC-BY-4.0", "CC-BY-SA-4.0"],
        licenses.TEMPLATES["ISC"] + " " + licenses.TEMPLATES["BSD-2-Clause"]: ["BSD-2-Clause", "ISC"],
        "Released under the licence of MIT.": [],
        licenses.TEMPLATES["ISC"][: len(licenses.TEMPLATES["ISC"]) // 2]: [],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in licenses.license_notices(docs).collect():
        got[r.doc_id].append(r.license)
    assert [sorted(got[i]) for i in range(len(texts))] == list(texts.values())


def test_templates_of_the_caller(spark):
    given = {"zoo": "No animal may leave by the northern gate after dark.", "one": "Beware!", "none": "..."}
    docs = [(1, f"x {given['zoo'].upper()} y"), (2, "no animal may leave by any northern gate after dark"), (3, "beware of it"), (4, "?")]
    got = licenses.license_notices(spark.createDataFrame(docs, "doc_id long, text string"), given).collect()
    assert sorted((r.doc_id, r.license, r.missing_words, r.other_words) for r in got) == [(1, "zoo", 0, 0), (2, "zoo", 1, 1), (3, "one", 0, 0)]


def test_every_template_at_every_place(spark, small):
    """Each template is laid against whole texts; what fits is in a notice that explains no fewer words."""
    rng = random.Random(9)
    rows = [(r.doc_id, r.text or "") for r in small.select("doc_id", "text").collect()]
    for i, (_, wording) in enumerate(licenses.TEMPLATES.items()):
        words = wording.split()
        for _ in range(len(words) // 14):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["changed"], [words[at], "added"]])
        before, after = (rng.choice(rows)[1].split()[:30] for _ in range(2))
        rows.append((100_000 + i, " ".join([*before, *words, *after])))
    matcher = licenses.Matcher(licenses.TEMPLATES)
    found = defaultdict(list)
    for r in licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.doc_id].append(r)
    some = 0
    for doc_id, text in rows:
        words = licenses.plain_words(text)
        numbers = np.array([matcher.number.get(w, -1) for w in words])
        places = [m.span() for m in licenses._WORD.finditer(text.lower())]
        for name, ours in matcher.numbers.items():
            missing, other, a, b = licenses.aligned(ours, numbers)
            if missing <= matcher.most[name] and other <= matcher.most[name]:
                some += 1
                start, end = places[a][0], places[b - 1][1]
                over = [r for r in found[doc_id] if r.start < end and start < r.start + r.length]
                assert any(len(matcher.words[r.license]) >= 0.9 * len(ours) for r in over), (doc_id, name)
    assert some >= len(licenses.TEMPLATES)


def test_alignment():
    rng = np.random.default_rng(6)
    for _ in range(200):
        ours, words = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(1, 9))
        best = min(
            len(ours) + (b - a) - 2 * licenses_common(ours, words[a:b]) for a in range(len(words) + 1) for b in range(a, len(words) + 1)
        )
        missing, other, a, b = licenses.aligned(ours, words)
        assert missing + other == best == len(ours) + (b - a) - 2 * licenses_common(ours, words[a:b])


def licenses_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_every_plain_notice_of_the_documents_is_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    notices = {t: n for n, t in licenses.TEMPLATES.items() if len(t) < 100}
    want = Counter(
        (r.doc_id, notices[line]) for r in docs.collect() for line in (r.text or "").split("\n") if line in notices
    )
    got = Counter((r.doc_id, r.license) for r in licenses.license_notices(docs).collect())
    assert want and want == got


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_leaks(spark, benchmark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.item_id: plain(r.text) for r in benchmark.collect()}
    texts = {r.doc_id: " ".join(plain(r.text)) for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, words in items.items() if f" {' '.join(words)} " in f" {t} "}
    got = {(r.doc_id, r.item_id): r for r in latent.benchmark_leaks(docs, benchmark).collect()}
    assert want and want <= set(got)
    assert len(set(got) - want) <= 0.02 * len(want)
    several = latent.benchmark_leaks(docs, benchmark, queries=7).select("doc_id", "item_id").collect()
    assert {tuple(r) for r in several} == set(got)
    kept = latent.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in got}


def test_paraphrases_are_found_and_fragments_are_not(spark, benchmark):
    rng = random.Random(0)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows, want = [], set()
    for k, item in enumerate(benchmark.orderBy("item_id").limit(20).collect()):
        words = item.text.split()
        if len(words) < 15:
            continue
        changed = list(words)
        for at in rng.sample(range(len(words)), len(words) // 6):
            changed[at] = f"zq{rng.randrange(10**6)}"
        around = docs[k][1].split()
        rows.append((2 * k, " ".join(around[:40] + changed + around[40:])))
        want.add((2 * k, item.item_id))
        rows.append((2 * k + 1, " ".join(around[:40] + words[: len(words) // 4] + around[40:])))
    found = latent.benchmark_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(got & want) >= 0.9 * len(want)
    assert not {d for d, _ in got if d % 2}


def test_an_item_in_a_third_of_the_documents_is_found(spark):
    rng = random.Random(7)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(300).collect()]
    for size in (3, 15, 27, 38):
        item = [f"leak{size}x{rng.randrange(12)}" for _ in range(size - 1)] + ["the"]
        rows = []
        for i, text in enumerate(texts):
            around = text.split()
            at = rng.randrange(len(around) + 1)
            rows.append((i, " ".join([*around[:at], *(item if i % 3 == 0 else item[: size // 3]), *around[at:]])))
        asked = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = latent.benchmark_leaks(docs, asked).collect()
        assert {r.doc_id for r in found} == {i for i, _ in rows if i % 3 == 0}


def test_every_item_of_a_large_benchmark_is_found(spark):
    rng = random.Random(17)
    items = [[f"w{rng.randrange(3_000)}" for _ in range(36)] for _ in range(1_200)]
    rows = []
    for i, item in enumerate(items[:200]):
        # No four words in a row stay.
        changed = [f"z{rng.randrange(10**6)}" if at % 4 == 3 else word for at, word in enumerate(item)]
        rows.append((i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(30)] + changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in latent.benchmark_leaks(docs, asked).collect()}
    assert found == {(i, i) for i in range(200)}


def test_items_that_share_an_opening_phrase_are_not_all_compared(monkeypatch):
    rng = random.Random(23)
    opening = "choose the one right answer to this"
    texts = [f"{opening} {' '.join(f'w{rng.randrange(20_000)}' for _ in range(30))}" for _ in range(5_000)]
    rows = []
    for i in range(400):
        words = [opening if rng.random() < 0.05 else f"v{rng.randrange(20_000)}" for _ in range(300)]
        rows.append(" ".join([*words[:150], *(texts[i : i + 1] if i % 20 == 0 else []), *words[150:]]))
    batch = pa.RecordBatch.from_pydict({"item_id": list(range(5_000)), "text": texts})
    items = list(latent._items(batch))
    compared = []
    plain_length = latent.common_subsequence
    monkeypatch.setattr(latent, "common_subsequence", lambda a, b: compared.append(1) or plain_length(a, b))
    # Opening words carry no weight, as those of a leak do.
    weights = np.ones(latent.BUCKETS, np.float32)
    weights[latent.buckets_of(latent.words_of(*buffer_of(pa.array([opening])))[0])] = 0
    search = latent._searching(weights, np.full(latent.BUCKETS, -1), np.zeros((0, 1), np.float32), items, (0.7, 0.6, 0.8))
    tracemalloc.start()
    found = search(pa.table({"text": rows}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found) == {(i, i) for i in range(0, 400, 20)}
    # All 5,000 items would be two comparisons each at each of about 6,000 openings.
    assert len(compared) < 1_000 and peak < 300e6


@pytest.mark.parametrize("seed", range(10))
def test_no_common_subsequence_exceeds_the_overlap(seed):
    rng = np.random.default_rng(seed)
    items = [latent.Item(i, rng.integers(0, 12, n, dtype=np.uint64), np.zeros(0, np.uint64)) for i, n in enumerate([1, 3, 9, 30])]
    overlap = latent.Overlap(items)
    region = rng.integers(0, 20, 25, dtype=np.uint64)
    numbers = np.array([0, 2, 3])
    counts = overlap.counts(numbers, region)
    assert counts.tolist() == [int(np.isin(items[n].hashes, region).sum()) for n in numbers]
    assert all(latent.common_subsequence(items[n].hashes, region) <= c for n, c in zip(numbers, counts, strict=True))


def test_leaks_of_awkward_rows(spark, awkward, empty, benchmark):
    assert latent.benchmark_leaks(awkward, benchmark).collect() == []
    assert latent.benchmark_leaks(empty, benchmark).collect() == []
    odd = spark.createDataFrame([(None, None), (1, ""), (2, AWKWARD[5][1]), (2, AWKWARD[5][1])], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in latent.benchmark_leaks(awkward, odd).collect()}
    assert found == {(4, 2), (5, 2)}
    assert latent.without_leaks(awkward, odd).count() == len(AWKWARD) - 3
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert latent.benchmark_leaks(awkward, nothing).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_common_subsequence(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 5, rng.integers(0, 90)), rng.integers(0, 5, rng.integers(0, 90))
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    assert latent.common_subsequence(a, b) == row[-1]


def test_the_latent_space_holds_the_items(spark, benchmark):
    weights = np.ones(latent.BUCKETS, np.float32)
    place, space = latent.latent_space(benchmark, weights)
    rows = [r for b in benchmark.toArrow().to_batches() for r in latent._rows(latent._items(b), weights)]
    dense = np.zeros((len(rows), len(space)))
    for i, (buckets, values) in enumerate(rows):
        dense[i, place[buckets]] = values
    assert np.allclose(dense @ space @ space.T, dense, atol=1e-3)
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-3)


def test_stages_keep_columns_and_rows_that_are_clean(spark, awkward, empty):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    clean = corpus_pipeline.toxicity_stage(spark, docs, LARGER)
    assert clean.columns == docs.columns
    marked = spark.read.parquet(f"{LARGER}/labels.parquet").join(docs, "doc_id").select("doc_id", "lang", "toxic").collect()
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    for lang in {r.lang for r in marked}:
        of = lambda want: [r.doc_id for r in marked if r.lang == lang and r.toxic == want]  # noqa: E731, B023
        assert sum(i not in kept for i in of(1)) >= 0.85 * len(of(1))
        assert sum(i in kept for i in of(0)) >= 0.98 * len(of(0))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, SF).columns == awkward.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_pipeline(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    with noted() as paths:
        rows = corpus_pipeline.run(spark, SF).collect()
    left = [p for p in paths if Path(p.removeprefix("file:")).exists()]
    assert [Path(p).name.split("-")[0] for p in left] == ["decontamination", "pieces"]
    assert len(paths) > 8
    left = {r.doc_id for r in rows}
    assert left < set(docs)
    lowered = [re.sub("[A-Z]", lambda m: m.group().lower(), docs[i] or "") for i in left]
    assert len(set(lowered)) == len(left)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert ends[:-1] == [o for o, _ in sorted(pieces)] and ends[-1] <= 1024


def test_the_layer_stays_finite_where_classes_part_cleanly():
    rng = np.random.default_rng(0)
    for n in (2, 50, 5_000):
        y = (np.arange(n) % 2).astype(float)
        x = np.stack([np.ones(n), 40 * y + rng.random(n), rng.random(n) * (y == 0), np.zeros(n)], axis=1)
        layer = toxicity._logistic(x, y)
        assert np.isfinite(layer).all()
        assert (((x @ layer) > 0) == (y > 0)).all()
    assert np.isfinite(toxicity._logistic(np.ones((4, 3)), np.zeros(4))).all()
    assert (toxicity._logistic(np.zeros((0, 3)), np.zeros(0)) == 0).all()
