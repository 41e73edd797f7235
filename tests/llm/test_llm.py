"""Every operator of the subpackage against brute force, an exact round trip or held-out accuracy, on small rows."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.functions import col

from lattica import runtime
from lattica.llm import bpe, chat, components, decontaminate, fim, licenses, lm, pii, prefix_trie, quality, registry, shingles, topk, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, key binary, tile long"


def documents(spark, texts, parts=3):
    """Rows with extra columns whose names the operators use inside."""
    rows = [(i, t, None, "s", None, 0.5, i, b"k", 7) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "é日本 ☃"), (5, "same row"), (5, "same row"), (None, "no id a@b.co"), (6, "word " * 40_000)]


# Memory of Python workers

HELD = """
import numpy as np
from lattica.runtime import tidied
resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 2**20
pins = []
def task(batches):
    for _ in range(2):  # what is freed first raises the size from which memory is mapped apart
        held = [(np.ones(1 << 17), pins.append(np.ones(64))) for _ in range(200)]
        yield resident()
        del held
before = resident()
most = max(tidied(task)(iter(())))
print(most - before, resident() - before)
"""


def test_a_worker_gives_back_what_a_task_has_freed():
    found = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=os.path.dirname(shingles.__file__) + "/../..")
    most, left = map(float, found.stdout.split())
    assert most > 150 and left < 40


def test_the_driver_gives_back_what_jobs_have_freed(spark, monkeypatch):
    monkeypatch.setattr(runtime, "_released", (0.0, 0.0))
    jvm = spark.sparkContext._jvm
    options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    ratios = lambda: [options.getVMOption(f"M{m}HeapFreeRatio").getValue() for m in ("in", "ax")]
    before, memory = ratios(), jvm.java.lang.Runtime.getRuntime()
    spark.range(4_000_000).selectExpr("size(collect_list(id))").first()
    jvm.System.gc()
    collected_only = memory.totalMemory()
    runtime.release(spark)
    assert memory.totalMemory() < 0.75 * collected_only and ratios() == before


# PII


def brute_pii(text):
    text = text or ""
    luhn = lambda d: sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    }


def test_pii_base_spans_equal_the_expressions():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("0012559.--+ @@ab()é:/") for _ in range(rng.randint(0, 40)))
        found = pii.find_spans(text)
        assert {k: found[k] for k in pii.BASE} == brute_pii(text), text


def test_pii_added_kinds_and_mask():
    text = "IBAN GB82WEST12345698765432, id 123-45-6789, https://me:pw@host.org at 12 High Street, mail a.b@c.org"
    found = pii.find_spans(text)
    cut = {k: [text[s:e] for s, e in v] for k, v in found.items()}
    assert cut["account"] == ["GB82WEST12345698765432"] and cut["identity"] == ["123-45-6789"]
    assert cut["login"] == ["me:pw@host.org"] and cut["address"] == ["12 High Street"]
    assert "a.b@c.org" in cut["email"]
    masked = pii.mask(text, found)
    assert "a.b@c.org" not in masked and "<EMAIL>" in masked and "<ADDRESS>" in masked
    assert pii.mask("nothing", pii.find_spans("nothing")) == "nothing"


def test_pii_time_follows_length():
    for text in ("1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "1 " * 200_000, "a.b@c" * 80_000):
        pii.find_spans(text)


def test_pii_query(spark):
    rows = {r["doc_id"]: r for r in pii.find_pii(documents(spark, EDGES)).collect()}
    assert len(rows) == len({i for i, _ in EDGES})
    assert rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[None]["n_email"] == 1
    assert pii.find_pii(documents(spark, [(1, "x")]).where("false")).count() == 0
    masked = pii.mask_pii(documents(spark, EDGES))
    assert masked.columns == documents(spark, EDGES).columns and masked.where("doc_id IS NULL").first()["text"] == "no id <EMAIL>"


def test_pii_cues():
    text = "Kontonummer: 4512 8890 77, Passport No. C01X00T478 and iban DE89 3704 0044 0532 0130 00 now; account of 12 people; 5 Old Mill Court"
    found = pii.find_spans(text)
    cut = {k: [text[s:e] for s, e in v] for k, v in found.items()}
    assert cut["account"] == ["4512 8890 77", "DE89 3704 0044 0532 0130 00"] and cut["identity"] == ["C01X00T478"] and cut["address"] == ["5 Old Mill Court"]
    wrong = "DE89 3704 0044 0532 0130 01 is none"
    assert pii.find_spans(wrong)["account"] == []


# BPE


@pytest.fixture(scope="module")
def ranks():
    return registry.public_ranks()


@pytest.fixture(scope="module")
def plain(ranks):
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.data.splitlines())}
    return tiktoken.Encoding("plain", pat_str=ranks.pattern, mergeable_ranks=table, special_tokens={})


def test_bpe_stitched_chunks_equal_the_whole(ranks, plain):
    rng, codec = random.Random(2), bpe.codec(ranks)
    pieces = ["a", "b", " ", "  ", "\n", "'ll", "'s", "'", "1", "é", "!", "...", "日", " the"]
    for n in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 120))) if n % 3 else rng.choice("a !") * rng.randint(0, 200)
        step, overlap = rng.choice([(8, 6), (16, 8), (5, 12)])
        starts = list(range(0, max(1, -(-(len(text) - overlap) // step)) * step, step))
        got = bpe.stitch(codec, starts, [text[s : s + step + overlap] for s in starts])
        assert np.frombuffer(got, "<u4").tolist() == plain.encode_ordinary(text), text


def test_bpe_gathers_long_runs_and_texts_in_rows(ranks, plain):
    rng, codec = random.Random(12), bpe.codec(ranks)
    for n in range(300):
        text = "".join(rng.choice(["ab ", "x" * rng.randint(1, 90), " " * rng.randint(1, 60), "1,5 ", "\n"]) for _ in range(rng.randint(0, 40)))
        got = bpe.encode_text(codec, text, rng.choice([4, 9, 32]), rng.choice([3, 8]))
        assert np.frombuffer(got, "<u4").tolist() == plain.encode_ordinary(text), text
    calls = []
    own, bpe.pretokenise = bpe.pretokenise, lambda c, t: calls.append(len(t)) or own(c, t)
    try:
        bpe.encode_text(codec, "q" * 60_000, 500, 50)
    finally:
        bpe.pretokenise = own
    assert sum(calls) < 6 * 60_000  # each character a few times, not once a chunk


def test_bpe_query_and_round_trip(spark, ranks, plain):
    texts = [*EDGES, (7, "<|endoftext|> is text"), (8, "x" * 3_000 + " y" * 500), (9, " " * 5_000), (10, "don't we'll " * 700)]
    encoded = bpe.encode(documents(spark, texts), ranks, chunk=1000, overlap=50)
    expected = sorted(((i, len(ids := plain.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes()) for i, t in texts), key=repr)
    assert [(i, n, bytes(b)) for i, n, b in collected(encoded, "doc_id", "n_tokens", "ids")] == expected
    decoded = collected(bpe.decode(encoded, ranks), "doc_id", "bytes")
    assert [(i, bytes(b)) for i, b in decoded] == sorted(((i, (t or "").encode()) for i, t in texts), key=repr)
    digests = bpe.encode(documents(spark, texts), ranks, digests=True)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert collected(digests, "doc_id", "ids_sha256", "decoded_sha256") == sorted(
        ((i, sha(np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()), sha((t or "").encode())) for i, t in texts), key=repr
    )
    assert bpe.encode(documents(spark, texts).where("false"), ranks).count() == 0


# Toxicity and quality


def auc(score, y):
    pairs = [(a > b) + 0.5 * (a == b) for a, la in zip(score, y) if la for b, lb in zip(score, y) if not lb]
    return sum(pairs) / len(pairs)


def spoken(rng, insult=None):
    words = [rng.choice("the of and stone river walk light green house under".split()) for _ in range(rng.randint(8, 60))]
    if insult:
        words[rng.randrange(len(words))] = insult
    return " ".join(words) + "."


def test_toxicity_tells_held_out_insults_and_gapped_ones():
    rng = random.Random(3)
    insults = ["blockhead", "nincompoop", "scoundrel"]
    rows = [(spoken(rng, rng.choice(insults)) if k % 4 == 0 else spoken(rng), int(k % 4 == 0)) for k in range(600)]
    machine = toxicity.fit([t for t, _ in rows[:400]], [y for _, y in rows[:400]])
    scorer = toxicity.Scorer(machine)
    assert auc(scorer.scores([t for t, _ in rows[400:]]), [y for _, y in rows[400:]]) > 0.97
    clean = scorer.scores([spoken(rng) for _ in range(30)]).max()
    for bent in ("block.head", "blockxhead", "b l o c k h e a d", "scoundrrel"):
        assert scorer.scores([spoken(rng, bent)])[0] > clean, bent
    again = toxicity.fit([t for t, _ in rows[:400]][::-1], [y for _, y in rows[:400]][::-1])
    assert np.allclose(again.weights, machine.weights)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_edges(spark, module):
    target = "toxic" if module is toxicity else "quality"
    score = toxicity.score_toxicity if module is toxicity else quality.score_quality
    rng = random.Random(4)
    texts = [*EDGES, *((i, spoken(rng, "scoundrel!!" if i % 3 == 0 else None)) for i in range(10, 200))]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None if i == 11 else int(i % 3 == 0)) for i in range(10, 200)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.train(docs, labels)
    rows = score(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % module.FOLDS == module.HELD_OUT)
    held = [r for r in rows if r["held_out"] and r["doc_id"] >= 10]
    assert auc([r["score"] for r in held], [r["doc_id"] % 3 == 0 for r in held]) > 0.9
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    none = module.train(docs, labels.where("false"))
    assert {round(r["score"], 6) for r in score(docs, none).collect()} == {0.5}
    assert score(docs.where("false"), model).count() == 0
    if module is toxicity:
        assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_a_margin_is_the_gapped_kernel_with_the_weights():
    from itertools import combinations

    def kernel_row(window):
        marked = [toxicity._START, *(int(c) for c in toxicity.codes([window])[0][1 : len(window) + 1]), toxicity._END]
        total = Counter()
        for size, span in ((3, 5), (4, 6)):
            for places in combinations(range(len(marked)), size):
                if places[-1] - places[0] < span:
                    number = 0
                    for p in places:
                        number = number * toxicity.ALPHABET + marked[p]
                    total[number + (toxicity.ALPHABET**3 if size == 4 else 0)] += toxicity.DECAY ** (places[-1] - places[0] + 1)
        return total

    rng = np.random.default_rng(6)
    rows = {w: kernel_row(w) for w in ("scoundrel", "scoxundrel", "idiot", "ab", "a")}
    numbers = np.array(sorted(set().union(*rows.values())))
    weights = rng.normal(size=len(numbers)).astype(np.float32)
    machine = toxicity.Machine(numbers, weights, 0.25, np.zeros(toxicity.SLOTS + 3))
    place = dict(zip(numbers.tolist(), weights.tolist()))
    for w, row in rows.items():
        size = toxicity.sizes(toxicity.codes([w]))[0]
        assert machine.margins([w])[0] == pytest.approx(sum(v * place[k] for k, v in row.items()) / size + 0.25, abs=1e-5)
    space = toxicity._Landmarks(["scoundrel", "idiot"])
    cross = sum(v * rows["scoundrel"][k] for k, v in rows["scoxundrel"].items())
    norm = toxicity.sizes(toxicity.codes(["scoundrel"]))[0] * toxicity.sizes(toxicity.codes(["scoxundrel"]))[0]
    assert space.kernel(["scoxundrel"])[0, 0] == pytest.approx(cross / norm)


def test_quality_statistics_by_hand():
    got = quality.statistics(b"Go go go!\nA-1 b b\n\nGo go go!")
    text = "Go go go!\nA-1 b b\n\nGo go go!"
    words, lines = text.split(), [x for x in text.split("\n") if x]
    share = lambda pick: sum(map(pick, text)) / len(text)
    assert got[0] == pytest.approx(share(str.isupper)) and got[1] == pytest.approx(share(str.isalpha)) and got[3] == pytest.approx(share(str.isdigit))
    assert got[11:16] == pytest.approx([math.log1p(len(text)), math.log1p(len(words)), np.mean([len(w) for w in words]), np.std([len(w) for w in words]), max(map(len, words))])
    assert got[16:19] == pytest.approx([len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words), sum(w.isalpha() for w in set(words)) / len(set(words))])
    assert got[19:22] == pytest.approx([math.log1p(len(lines)), len(set(lines)) / len(lines), len(text) / len(lines)])
    counts = Counter(text)
    assert got[22] == pytest.approx(-sum(c / len(text) * math.log2(c / len(text)) for c in counts.values()))


def test_trees_flattened_descend_as_grown():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.grow(x[:600], y[:600], trees=40, least=1.0)
    assert auc(trees.score(x[600:]), y[600:] > 0) > 0.97
    one = trees.score(x[:1])[0]
    total = trees.base
    for t in range(len(trees.feature)):
        node = 0
        while node < trees.feature.shape[1]:
            node = 2 * node + 1 + (x[0, trees.feature[t, node]] > trees.threshold[t, node])
        total += trees.leaf[t, node - trees.feature.shape[1]]
    assert one == pytest.approx(1 / (1 + math.exp(-total)))


# Shingle join


def brute_join(rows, size, percent):
    sets = []
    for _, t in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return sorted(((i, len(sets[a]), least.get(root(a))) for a, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("size", "percent", "n"), [(4, 85, 400), (2, 50, 200)])
def test_shingle_join_misses_no_link(spark, size, percent, n):
    rng = random.Random(size)
    vocabulary = [chr(97 + i) * 2 for i in range(26)] + ["The", "é", "x"]
    rows = [(-5, None), (-4, ""), (-3, "one two"), (-2, "ONE two"), (None, "one two"), (-1, " ")]
    for i in range(n):
        kind = rng.random()
        if kind < 0.25:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 150])))
        else:
            words = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        rows.append((i * 7, text))
    rows.append(rows[-1])  # a repeated row
    docs = documents(spark, rows)
    assert collected(shingles.join_shingles(docs, size, percent), "doc_id", "n_shingles", "component_id") == brute_join(rows, size, percent)


def test_shingle_tiles_meet_wherever_sets_link():
    rng = np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        gone = int(rng.integers(0, max(1, len(x) * 15 // 100 + 1)))
        y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, int(rng.integers(0, 20))).astype(np.uint64)]))
        if len(y) and shingles.links(x, y, 85):
            assert np.intersect1d(shingles.tile_names(x, 85), shingles.tile_names(y, 85)).size


def test_large_sets_share_as_many_tiles_as_promised():
    rng = np.random.default_rng(13)
    linked = 0
    for _ in range(60):
        n = int(rng.integers(1_000, 5_000))
        x = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        kind = rng.integers(0, 3)
        gone, new = [(0, int(0.17 * n)), (int(0.149 * n), 0), (int(0.08 * n), int(0.08 * n))][kind]
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(1, 2**63, new).astype(np.uint64)]))
        if shingles.links(x, y, 85):
            linked += 1
            assert np.intersect1d(shingles.tile_names(x, 85), shingles.tile_names(y, 85)).size >= min(shingles.shared(len(x)), shingles.shared(len(y)))
    assert linked > 40


def test_a_passage_that_many_share_hides_no_link(spark, monkeypatch):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(120)]
    rows = []
    for k in range(90):
        own = [word() for _ in range(rng.choice([0, 2, 15, 60, 150]))]
        rows.append((k, " ".join(passage + own)))
        if k % 3 == 0:
            near = passage + own
            near[rng.randrange(len(near))] = word()
            rows.append((500 + k, " ".join(near)))
    monkeypatch.setattr(shingles, "POPULAR", 3)  # most tiles of the passage are popular then
    monkeypatch.setattr(shingles, "STRETCH", 2_000)
    for few in (1 << 20, 0):
        monkeypatch.setattr(shingles, "BROADCAST_SHINGLES", few)
        got = collected(shingles.join_shingles(documents(spark, rows)), "doc_id", "n_shingles", "component_id")
        assert got == brute_join(rows, 4, 85)


def test_near_copies_behind_popular_tiles_meet_their_hub_and_not_each_other(spark, monkeypatch):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(150)], []
    for k in range(120):
        near = list(base)
        for place in rng.sample(range(150), rng.choice([1, 2, 3])):
            near[place] = word()
        rows.append((k, " ".join(near)))
    # strangers with a passage of it have the smallest ids
    rows += [(-1 - k, " ".join(base[at : at + 60] + [word() for _ in range(150)])) for k, at in enumerate(range(0, 90, 8))]
    monkeypatch.setattr(shingles, "POPULAR", 3)
    made, kept = {}, shingles.written

    def counted(df, name):
        out = kept(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(shingles, "written", counted)
    want = brute_join(rows, 4, 85)
    for few in (1 << 20, 0):
        monkeypatch.setattr(shingles, "BROADCAST_SHINGLES", few)
        made.clear()
        assert collected(shingles.join_shingles(documents(spark, rows)), "doc_id", "n_shingles", "component_id") == want
        assert 0 < made["unsafe-sets"] and made["popular-pairs"] < len(rows), made


def test_met_keeps_tiles_across_batches():
    import pyarrow as pa

    rng = random.Random(8)
    for _ in range(200):
        rows = sorted({(rng.randint(0, 8), rng.randint(0, 30)) for _ in range(rng.randint(0, 25))})
        cuts = sorted(rng.sample(range(len(rows) + 1), min(3, len(rows) + 1)))
        pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in p], pa.int64()), pa.array([d for _, d in p], pa.int64())], names=["tile", "doc"]) for p in pieces]
        got = [tuple(r.values()) for b in shingles._met(iter(batches)) for r in b.to_pylist()]
        count = Counter(t for t, _ in rows)
        least = {t: min(d for u, d in rows if u == t) for t in count}
        assert sorted(got) == [(t, d, least[t]) for t, d in rows if count[t] > 1]


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)]
    got = dict(collected(components.connected_components(spark.createDataFrame(links, "a long, b long")), "id", "component"))
    group = {}
    for a, b in links:
        if a != b:
            both = group.get(a, {a}) | group.get(b, {b})
            for x in both:
                group[x] = both
    assert got == {x: min(g) for x, g in group.items()}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_alike_rows_leave_a_task_once():
    import pyarrow as pa

    texts = [" ".join(f"w{k}" for k in range(200)) + f" x{i}" for i in range(100)] + [None, ""]
    rows = [r for b in shingles._counted(4, iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])) for r in b.to_pylist()]
    sets = Counter(x for t in texts for x in shingles.Shingler(4).shingles(t).view(np.int64).tolist())
    assert {r["shingle"]: r["times"] for r in rows} == sets and len(rows) == len(sets) == 297


def test_keep_one_keeps_columns(spark):
    docs = documents(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other"), (None, "a b c d e f g"), (4, None)])
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, None, 4}


# Decontamination


def brute_hits(items, doc, window):
    hit, found = [0] * len(doc), set()
    for name, item in items:
        for w in [item[i : i + window] for i in range(len(item) - window + 1)] if len(item) >= window else [item] if item else []:
            for p in range(len(doc) - len(w) + 1):
                if doc[p : p + len(w)] == w:
                    found.add(name)
                    hit[p : p + len(w)] = [1] * len(w)
    return hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(10)
    for _ in range(800):
        window = rng.choice([2, 3, 4, 5])
        letters = [bytes([97 + i]) for i in range(rng.choice([1, 2, 3, 6]))]
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(0, 5))]
        doc = [rng.choice([*letters, b"zz"]) for _ in range(rng.randint(0, 40))]
        hits, found = decontaminate.Automaton(items, window).scan(doc)
        got = [0] * len(doc)
        for s, e in hits:
            got[s:e] = [1] * (e - s)
        assert (got, found) == brute_hits(items, doc, window)


def test_decontamination_query_and_shards(spark):
    rng = random.Random(11)
    vocabulary = [f"W{k}" for k in range(40)] + ["née", "x1"]
    item = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))
    items = [(k, item()) for k in range(12)] + [(20, None), (21, "?!"), (22, "alpha")]
    texts = list(EDGES)
    for i in range(30, 80):
        words = item().lower() + "; " + " ".join(rng.choice(["q", "r", "s"]) for _ in range(rng.randint(0, 300)))
        texts.append((i, (rng.choice(items)[1] or "") + "\n" + words if i % 2 else words))
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    expected = []
    for i, t in texts:
        doc = word.findall(low(t))
        if len(doc) > 20_000:
            hit, found = [0] * len(doc), set()
        else:
            hit, found = brute_hits([(str(n), word.findall(low(x))) for n, x in items], doc, 13)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected.append((i, len(doc), sum(hit), len(found), sha, sum(hit) > 0 and 20 * sum(hit) >= len(doc)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for shard in (decontaminate.SHARD_CHARS, 60):
        assert collected(decontaminate.contamination_report(docs, bench, shard_chars=shard), *columns) == sorted(expected, key=repr)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not e[5] for e in expected)
    assert decontaminate.contamination_report(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination_report(docs.where("false"), bench).count() == 0


def test_long_hits_are_cut(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(15)))], "item_id long, text string")
    text = "start " * 400 + " ".join(f"B{k}" for k in range(15)) + " end"
    docs = documents(spark, [(1, text), (2, None)])
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, max_hit_words=13).collect()}
    assert cut == {1: "start " * 400 + " end", 2: None}


# Chat


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "&lt;| &amp; <|im_end|>\n"), (1, 1, "assistant", "tie"),
        (2, None, None, None), (2, 3, "assistant", ""), (2, 2, "sys\ntem&#10;", "x&#10;y"), (None, 0, "user", "no id"), (3, 0, "assistant", "é日" * 5000),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(col("text")))
    got = collected(chat.digest(chat.format_chats(messages)), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    expected = []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", chat_escape(r[3])))
        said = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for role, t in said if role == "assistant")
        expected.append((conv, len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)), len(loss), sha(loss)))
    assert got == sorted(expected, key=repr)
    assert chat.digest(chat.format_chats(messages.where("false"))).count() == 0


def chat_escape(text):
    return (text or "").replace("&", "&amp;").replace("<|", "&lt;|")


def test_chat_parts(spark):
    parts = "array<struct<kind:string,text:string,ref:string,units:double>>"
    content = [("text", "see <|image|>", None, None), ("image", None, "a.png", 2.0), (None, "and", None, None), ("audio", None, "b.wav", 1.5), ("document", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {parts}")
    row = chat.format_chats(df).first()
    assert row["formatted"] == "<|im_start|>user\nsee &lt;|image|><|image|>and<|audio|><|document|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 512), ("audio", "b.wav", 38), ("document", None, 0)]
    assert row["expanded_tokens"] == 550


# Vectors


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(40):
        base = rng.normal(size=8)
        rows += [(len(rows) + j, (base * rng.uniform(0.5, 3) + rng.normal(size=8) * 0.15).tolist()) for j in range(int(rng.integers(1, 8)))]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (903, []), (904, [0.0] * 8), (905, [1.0, None] + [0.0] * 6), (906, [float("nan")] * 8), (907, [1.0, 2.0]), (908, [2.0, 4.0]), (909, [float("inf")] * 8), (910, [1e-30] * 8), (911, [1e30] * 8)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows] + [(None, rows[0][1], 1, 2)], "vec_id long, embedding array<double>, rep long, key long").repartition(3)
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: {i} for i, _ in rows}
    count = Counter()
    for i, x in good:
        for j, y in good:
            if i != j and len(x) == len(y) and (x / np.abs(x).max()) @ (y / np.abs(y).max()) / np.linalg.norm(x / np.abs(x).max()) / np.linalg.norm(y / np.abs(y).max()) >= 0.9:
                count[i] += 1
                both = near[i] | near[j]
                for k in both:
                    near[k] = both
    expected = sorted([(i, count[i], min(near[i]), min(near[i]) == i) for i, _ in rows] + [(None, 0, None, True)], key=repr)
    assert collected(vectors.link_vectors(table), "vec_id", "n_links", "component_id", "kept") == expected
    assert vectors.link_vectors(table.where("false")).count() == 0


def test_bounds_leave_no_link(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(700, 12)) @ np.diag(np.linspace(3, 0.1, 12))
    norm = np.linalg.norm(x, axis=1)
    axes = {8 * 12: np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()}
    i, j = vectors.linked_pairs(x, norm, x, norm, axes, 0.9, True)
    cosine = x @ x.T / np.outer(norm, norm)
    a, b = np.nonzero(np.triu(cosine >= 0.9, 1))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(a.tolist(), b.tolist()))


# Language model


def test_elias_fano():
    rng = np.random.default_rng(14)
    for _ in range(120):
        n, universe = int(rng.integers(0, 200)), int(rng.choice([5, 50, 1000, 10**6, 10**12]))
        v = np.unique(rng.integers(0, universe, n))
        e = lm.EliasFano.encode(v, universe)
        if len(v):
            i = rng.integers(0, len(v), 50)
            assert (e.get(i).astype(np.int64) == v[i]).all()
        x, b = rng.integers(0, universe, 40), rng.integers(0, len(v) + 1, 40)
        end = b + rng.integers(0, len(v) + 1 - b)
        place, hit = e.successor(x.astype(np.uint64), b, end)
        for k in range(40):
            over = [p for p in range(b[k], end[k]) if v[p] >= x[k]]
            assert place[k] == (over[0] if over else end[k]) and hit[k] == (bool(over) and v[over[0]] == x[k])


def test_language_model(spark):
    rng = random.Random(15)
    def walk(n):  # most words tell the next one, which counts of single words can't use
        at, out = 0, []
        for _ in range(n):
            at = (at + 1) % 7 if rng.random() < 0.9 else rng.randrange(7)
            out.append("abcdefG"[at])
        return " ".join(out)

    texts = [*EDGES[:-1], *((i, walk(rng.randint(0, 60))) for i in range(20, 120))]
    docs = documents(spark, texts)
    tokens = {k: [*(t or "").lower().encode().split(), None] for k, (_, t) in enumerate(texts)}
    learned = [k for k, (i, _) in enumerate(texts) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for k in learned for w in tokens[k])
    n, v = sum(count.values()), len(count)
    expected = sorted(((i, len(tokens[k]), sum(count[w] > 0 for w in tokens[k]), n, round(sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in tokens[k]), 8)) for k, (i, _) in enumerate(texts)), key=repr)
    rows = lm.score_documents(docs).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 8)) for r in rows), key=repr)
    assert got == expected
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["score"] < 0 for r in rows)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score_documents(docs.where("false")).count() == 0


def test_words_are_looked_up_a_portion_at_a_time(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    docs = documents(spark, [(1, "a b a"), (2, None)])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: task)
    asked = []

    class Trie:
        def ids(self, hashes):
            asked.append(len(hashes))
            return np.where(hashes == lm.END, 7, -1), np.where(hashes == lm.END, 0.5, 0.0)

    texts = ["a b a", None, "", "B c d e", "f"]
    columns = [pa.array(range(5)), pa.array([False] * 5), pa.array([True] * 5), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "learned", "text"])
    (out,) = lm.number_texts(docs, Trie())(iter([batch]))
    assert asked == [13]  # once for all five texts
    assert out.column("n_tokens").to_pylist() == [4, 1, 1, 5, 2] and out.column("n_known").to_pylist() == [1] * 5
    assert out.column("logs").to_pylist() == [0.5] * 5
    assert [np.frombuffer(b, "<i4").tolist() for b in out.column("ids").to_pylist()] == [[-1, -1, -1, 7], [7], [7], [-1] * 4 + [7], [-1, 7]]


def test_trie_probabilities_sum_to_one():
    rng = np.random.default_rng(16)
    hashes, total = np.sort(rng.choice(10**6, 40, replace=False)), 0
    stream = rng.choice(50, 6000, p=np.arange(1, 51) / 1275.0)
    counts = np.bincount(stream, minlength=50)
    trie = lm.Trie(hashes, counts[:40], int(counts.sum()), 50)
    pairs = np.bincount(stream[:-1] * 50 + stream[1:], minlength=2500)
    keys = np.array([a * 40 + b for a in range(40) for b in range(40) if pairs[a * 50 + b] >= 2])
    trie.add_level(keys, np.array([pairs[k // 40 * 50 + k % 40] for k in keys]))
    for context in range(0, 40, 7):
        ids = np.array([x for w in range(40) for x in (context, w)])
        fresh = np.arange(len(ids)) % 2 == 0
        inside = (10 ** trie.scores(ids, fresh)[1::2]).sum()
        outside = 10 ** trie.scores(np.array([context, -1]), np.array([True, False]))[1] * (50 - 40 + 1)
        assert inside + outside == pytest.approx(1, abs=0.05)


def test_language_model_keeps_rare_words_of_a_large_corpus(spark):
    # over 2^22 tokens, of which the pair has two each
    texts = [(i, "the cat " * 50_000) for i in range(100, 160)] + [(i, "zig zag") for i in learned_ids(2)] + [(None, "zig zag"), (None, "zig zog")]
    rows = lm.score_documents(documents(spark, texts)).where("doc_id IS NULL").orderBy("base_score").collect()
    assert rows[0]["train_tokens"] > 2**22 and [r["n_known"] for r in rows] == [2, 3]
    # zig by its two occurrences, zag by the pair, the end by the three and else by its pair
    n, pair = rows[0]["train_tokens"] + 0.5, 1.25 / 2
    assert rows[1]["score"] == pytest.approx(math.log10(2 / n) + math.log10(pair) + math.log10(pair + (1 - pair) * pair), abs=0.001)


def learned_ids(n):
    return [i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 7 != 2][:n]


def test_language_model_in_shards_equals_brute_force(spark):
    rng = np.random.default_rng(17)
    texts = [(i, " ".join(f"w{k}" for k in rng.zipf(1.5, rng.integers(0, 60)) if k < 90)) for i in range(150)]
    shards, numbered = lm.train(documents(spark, texts), shard=20)
    assert len(shards.words.files) > 2 and all(len(level.files) > 2 for level in shards.levels)
    rows = numbered.collect()
    ids = [np.frombuffer(r["ids"], "<i4").tolist() for r in rows]
    learned = [i for i, r in zip(ids, rows, strict=True) if r["learned"]]
    count = Counter(tuple(i[k : k + n]) for i in learned for n in (1, 2, 3) for k in range(len(i) - n + 1))
    count = {g: c for g, c in count.items() if len(g) == 1 or c >= 2}
    used = Counter()
    for g, c in count.items():
        used[g[:-1]] += c - 0.75

    def probability(context, w):
        if not context:
            return count.get((w,), 0.5) / (shards.total + 0.5)
        shorter = probability(context[1:], w)
        if context not in count:
            return shorter
        return max(count.get((*context, w), 0) - 0.75, 0) / count[context] + (1 - used[context] / count[context]) * shorter

    for i in ids:
        expected = [math.log10(probability(tuple(i[max(0, k - 2) : k]), w)) for k, w in enumerate(i)]
        assert np.allclose(shards.scores(np.array(i), np.arange(len(i)) == 0), expected, atol=1e-6)


# Licences


def test_licenses(spark):
    mit = licenses.SENTENCES[2][0] + "\n\n" + licenses.SENTENCES[3][0] + ".\n" + licenses.SENTENCES[4][0] + "."
    texts = [*EDGES, (20, "Intro.\nReleased under the MIT License."), (21, mit), (22, "all RIGHTS reserved!\nLicensed under CC BY-NC 4.0."), (23, "licensed under the apache license version 2 0")]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert rows[20]["licenses"] == "MIT" and rows[21]["sentence_ids"] == "2,3,4" and rows[21]["licenses"] == "MIT"
    assert rows[22]["licenses"] == "CC-BY-NC-4.0,proprietary" and rows[22]["sentence_ids"] == "21,12" and rows[23]["licenses"] == "Apache-2.0"
    assert rows[1]["n_sentences"] == 0 and rows[None]["n_licenses"] == 0
    assert licenses.scan_licenses(documents(spark, texts).where("false")).count() == 0


# Pipeline


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == columns and {r["doc_id"] for r in kept.select("doc_id").collect()} <= before
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    joined = brute_join([(i, t) for i, t in texts if len(t) < 20_000], 4, 85)
    assert all(i == c for i, _, c in joined)
    assert not any(v for _, t in texts for v in brute_pii(t).values())
    last = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in last.collect()} == {i for i, _ in texts}


# Licences in files


def wrapped(text, width, prefix):
    import textwrap

    return "\n".join(prefix + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


NOTICES = {
    "MIT": [2, 3, 4],
    "Apache-2.0": [5, 6, 7],
    "GPL-3.0": [9, 10],
    "GPL-2.0-or-later": [24, 11, 10],
    "BSD-3-Clause": [16, 17, 18, 19],
    "ISC": [22],
    "Zlib": [32, 33],
    "Unlicense": [23],
}


def test_notices_are_found_wrapped_and_commented(spark):
    texts, expected = [], {}
    for k, (name, ids) in enumerate(NOTICES.items()):
        sentences = [licenses.SENTENCES[i][-1 if i == 5 else 0] if i != 5 else licenses.SENTENCES[5][1] for i in ids]
        whole = ".\n\n".join(sentences) + "."
        run = ". ".join(sentences) + "."
        for j, text in enumerate([whole, run, wrapped(whole, 72, ""), wrapped(run, 72, ""), wrapped(whole, 60, " * "), wrapped(run, 60, "# "), wrapped(run, 60, "// ").replace("\n", "\r\n")]):
            doc = 100 * k + j
            texts.append((doc, f"Some words before.\n\n{text}\n\nand after"))
            expected[doc] = (name, ",".join(map(str, ids)))
    texts += [(9001, "// SPDX-License-Identifier: MPL-2.0\nint x;"), (9002, "prose line\nLicensed under CC BY 4.0\nmore prose"), (9003, "The MIT Licence is not named here")]
    expected |= {9001: ("MPL-2.0", "20"), 9002: ("CC-BY-4.0", "13"), 9003: ("", "")}
    got = {r["doc_id"]: (r["licenses"], r["sentence_ids"]) for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert got == expected


def brute_licenses(text):
    """The same scan, character by character."""
    known, pieces, piece, k = licenses.sentence_ids(), [], "", 0
    while k < len(text):
        ends = k
        while ends < len(text) and text[ends] in ".!?:;":
            ends += 1
        closed = ends
        while ends > k and closed < len(text) and text[closed] in "\"')]":
            closed += 1
        if ends > k and (closed == len(text) or text[closed] in " \t\n\r\f"):
            pieces.append(piece)
            piece, k = "", closed + 1
            continue
        if text[k] == "\n":
            far = k + 1
            last = None
            while far < len(text) and not (text[far].isascii() and text[far].isalnum()):
                last = far if text[far] == "\n" else last
                far += 1
            if last is not None:
                pieces.append(piece)
                piece, k = "", last + 1
                continue
        piece += text[k]
        k += 1
    ids = []
    for s in [*pieces, piece]:
        bare = ["".join(c for c in line.lower() if c.isascii() and c.isalnum()) for line in s.split("\n")]
        whole = "".join(bare)
        ids += [known[whole]] if whole in known else [known[b] for b in bare if b in known] if len(bare) > 1 else []
    return ids


def test_licences_equal_brute_force(spark):
    rng = random.Random(15)
    parts = [s for group in licenses.SENTENCES.values() for s in group if not s.startswith(licenses.SPDX)]
    texts = [(0, None), (1, ""), (2, "\n\n"), (3, "word " * 30_000 + "\nMIT License\n")]
    for i in range(4, 240):
        text = "".join(rng.choice([rng.choice(parts), ". ", ".\n", "\n", "\n\n", "\n * ", "\n#\n", "; ", ": ", " é ", "x", '."\n', " "]) for _ in range(rng.randint(0, 14)))
        texts.append((i, rng.choice([text, wrapped(text, 40, rng.choice(["", "# ", " * "]))])))
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert got == {i: ",".join(map(str, brute_licenses(t or ""))) for i, t in texts}
    assert licenses.scan_licenses(documents(spark, texts).where("false")).count() == 0


def test_ten_shards_take_one_pass(spark):
    rng = random.Random(16)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 13, 40])))) for k in range(60)]
    texts = [(i, " ".join([rng.choice(vocabulary) for _ in range(50)] + [rng.choice(items)[1]] * (i % 2))) for i in range(80)]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.contamination_report(docs, bench)
    most = max(len(t) for _, t in items)
    many = decontaminate.contamination_report(docs, bench, shard_chars=sum(len(t) for _, t in items) // 10)
    assert sum(len(t) for _, t in items) // 10 >= most
    assert len(list(decontaminate._shards(bench, "item_id", "text", sum(len(t) for _, t in items) // 10))) >= 10
    assert collected(one, *one.columns) == collected(many, *many.columns)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_vector_cells_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(17)
    centers = rng.normal(size=(12, 24))
    x = np.concatenate([centers[rng.integers(0, 12, 700)] + 0.35 * rng.normal(size=(700, 24)), rng.normal(size=(100, 24))])
    monkeypatch.setattr(vectors, "LEAST_ROWS", 8)
    monkeypatch.setattr(vectors, "MOST_ROWS", 8)
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.link_vectors(rows).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], *(root[j] for j in np.flatnonzero(linked[i])), root[i]) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    assert got == {i: (int(linked[i].sum()), int(root[i])) for i in range(len(x))}


# SQL of the joins


@pytest.mark.parametrize("name", ["op4_shingles", "op5_decontaminate", "op10_licenses", "op11_prefix_trie", "op12_topk", "op13_fim"])
def test_against_duckdb(spark, name):
    import duckdb

    sf_dir, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = sorted(map(str, result.fetchall()))
    got = registry.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names) and sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == expected


# Fill-in-middle


def brute_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(t) for t in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    return (len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_equals_brute_force_and_round_trips(spark):
    rng = random.Random(13)
    texts = [(i, "".join(rng.choice(["a", "é日", "<", ">", "P", "S", "<P", "S>", " ", "\n", " ", "\x1c", "\x00", "☃ "]) for _ in range(rng.randint(0, 40)))) for i in range(100, 500)]
    texts += [*EDGES, (7, "has <M> inside"), (8, "<P><S><M>"), (9, " \t"), (-5, "negative id here"), (10, "x\r\ny  z ")]
    got = collected(fim.restore(fim.transform(documents(spark, texts))), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    assert got == sorted(((i, *brute_fim(i, t), t or "") for i, t in texts), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fim.digest(fim.restore(fim.transform(documents(spark, [(1, "x")]).where("false")))).count() == 0


def test_fim_rates_and_seed(spark):
    texts = [(i, "one two three four five") for i in range(300)]
    forms = lambda **options: Counter(r["form"] for r in fim.transform(documents(spark, texts), **options).collect())
    assert forms(fim_percent=0) == {"plain": 300} and forms(fim_percent=100, spm_percent=0) == {"psm": 300}
    assert fim.transform(documents(spark, texts), seed=7).select("output").collect() != fim.transform(documents(spark, texts)).select("output").collect()


# Prefix trie


def brute_trie(rows, shared=True):
    """Nodes by a walk over all prefixes."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(conv, []).append(((turn is not None, turn or 0, said), role, text))
    own = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        children = lambda x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x]
        leaves = sum(not children(x) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children(k)), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn int, role string, text string, part int, hi long, chars string, level double"


def turns(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 5, 1, "c", 0.0) for r in rows], TURNS).repartition(parts)


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", None, "bot"]), rng.choice(["a", "b", None, "é☃"])) for c in range(-3, 120) for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", f"same {t}") for c in range(500, 540) for t in range(7)]  # copies
    rows += [(700, t, "user", "long") for t in range(40)] + [(701, t, "user", "long") for t in range(23)]
    rows += [(800, None, "z", "last"), (800, None, "a", "first"), (800, 1, "a", "x" * 50_000), (800, 1, "a", "x" * 50_000), (None, 1, "user", "no id"), (801, 0, None, None)]
    frame = turns(spark, rows)
    assert collected(prefix_trie.prefix_trie(frame, prefix_trie.shared_opening), *TRIE) == brute_trie(rows)
    assert collected(prefix_trie.prefix_trie(frame), *TRIE) == brute_trie(rows, shared=False)


def test_trie_of_stretches_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    rows = [(c, t, "user", str(t)) for c in range(90) for t in range(2)] + [(200, t, "user", f"{t % 5}") for t in range(60)]
    assert collected(prefix_trie.prefix_trie(turns(spark, rows)), *TRIE) == brute_trie(rows, shared=False)
    assert prefix_trie.prefix_trie(turns(spark, rows).where("false"), prefix_trie.shared_opening).count() == 0


def test_trie_deals_a_long_conversation_over_tasks(spark):
    rows = [(7, t, "user", f"{t % 5}") for t in range(4_000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = prefix_trie._ordered(turns(spark, rows), "conv_id", "turn", "role", "text")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert dealt.groupBy("part").count().count() == 4


# Top-k search


def brute_topk(rows, k, asked):
    """All products, with rows that are equal in id and vector once."""
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(max(-topk.LARGEST, min(topk.LARGEST, 64 * x))) for x in v]
            while x and x[-1] == 0:
                x.pop()
            kept[i, tuple(x)] = None
    out = []
    for q in kept:
        if asked(q[0]):
            others = [(max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q[1], d[1], strict=False)))), d[0]) for d in kept if d != q]
            out += [(q[0], r + 1, i, s) for r, (s, i) in enumerate(sorted(others, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, v binary, rep long, block int, kind string"


def vector_rows(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, b"v", 2, 3, "k") for i, v in rows], VECTORS).repartition(parts)


def test_topk_equals_brute_force(spark, monkeypatch):
    for name, value in {"BLOCK_ROWS": 16, "PART_ROWS": 4, "ROUNDS": (1, 3), "LEAST_BATCH": 4, "ASKS": 2, "STEP": 64}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 9))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=9)).tolist()) for i in range(400)]
    rows += [(1_000 + i, [0.5] * 9) for i in range(100)]  # one vector in a fifth of all rows
    rows += [(2_000, None), (2_020, [1.0, None]), (2_040, [float("nan")] * 9), (2_060, [float("inf")]), (2_080, []), (2_100, [1.5]), (2_120, [0.0] * 12), (None, [1.0] * 9)]
    rows += [(3_000, [0.25] * 9), (3_000, [0.25] * 9), (3_020, [0.25] * 9), (3_020, [0.5, -0.5]), (-20, [-1.0] * 11)]
    got = collected(topk.top_k(vector_rows(spark, rows), k=7), "query_id", "rank", "vec_id", "score")
    assert got == brute_topk(rows, 7, lambda i: i % 20 == 0)
    assert topk.top_k(vector_rows(spark, rows).where("false")).count() == 0


def test_topk_of_few_and_of_large_components(spark):
    rows = [(0, [1e300, -1e300]), (20, [1e300, 1.0]), (40, [1e17, 2.0]), (41, [2.0**40, 3.0]), (60, [0.1, 0.2])]
    got = collected(topk.top_k(vector_rows(spark, rows)), "query_id", "rank", "vec_id", "score")
    assert got == brute_topk(rows, 20, lambda i: i % 20 == 0)
    assert collected(topk.top_k(vector_rows(spark, rows), k=2, asked=col("vec_id") == 41), "query_id", "rank", "vec_id", "score") == brute_topk(rows, 2, lambda i: i == 41)


def test_topk_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-3, 4, (64, 16)) + 40 * np.eye(16, dtype=int)[c] for c in range(16)])
    most, least = x.reshape(16, 64, 16).max(1), x.reshape(16, 64, 16).min(1)
    reach = topk.bounds(x[::50], most, least)
    exact = (x[::50] @ x.T).reshape(-1, 16, 64).max(2)
    assert (reach >= exact).all()
    kth = np.sort(x[::50] @ x.T, axis=1)[:, -20]
    assert (reach < kth[:, None]).mean() > 0.5  # most blocks are never asked
    block = {"x": x, "most": most, "least": least, "starts": np.arange(len(x) + 1), "ids": np.arange(len(x))}
    scores, ids = topk.score_block(x[::50], np.full(len(x[::50]), topk.NONE), block, 20)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), (len(scores), len(x))), -(x[::50] @ x.T)), axis=-1)[:, :20]
    assert (ids == order).all() and (scores == np.take_along_axis(x[::50] @ x.T, order, 1)).all()
