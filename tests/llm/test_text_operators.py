"""Operators on documents against brute force, with odd inputs."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenmill.llm import decontam, linededup, minhash, mixing, quality_rules
from lumenmill.llm.textnp import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "a common line that many documents share, word for word"
BODY = " ".join(f"w{i}" for i in range(200))

ROWS = [
    (0, None, "s1"), (1, "", None), (2, " \t\n ", "s1"), (3, "one", "s2"), (4, "Éa b\x85c d é", "s2"),
    (5, "x " * 60_000, "s3"), (6, BODY, "s1"), (6, BODY, "s1"), (7, BODY + " extra", "s1"), (8, BODY.upper(), None),
    (None, "no id here", "s1"), (9, "q\n\nQ \nq\n" + LINE, "s3"), (10, "ab cd", "s2"), (11, "ab cd", "s2"), (12, "a b a b a b a b", "s2"),
    *[(100 + i, f"{LINE}\nown line {i}\n {LINE.upper()} \n" + " ".join(f"t{i}x{j % 37}" for j in range(80)), "s4") for i in range(12)],
]
SCHEMA = "doc_id long, text string, source string, size int, n_lines int, n_words string, kept string, target int, drops int, salt int, key int, component_id int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3, 4, 5, 6, 7) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def thue_morse(n):
    """A word over a and b, and its complement: polynomial hashes modulo a power of two can't tell them apart."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [3, 5, 11])
def test_equality_of_words_and_lines(n):
    a, b = thue_morse(n)
    got = quality_rules.measure(Texts(pa.array([f"{a}\n{b}", f"{a}\n{a}", f"{a} x\n{b} x\n{a} x"])))
    assert got["n_dup_lines"].tolist() == [0, 1, 1]
    one, two = minhash.shingle_sets(Texts(pa.array([a, b])), 2)
    assert one.tolist() != two.tolist()


def test_spans_of_every_length():
    text = "".join(chr(33 + (i * i) % 90) for i in range(400))
    t = Texts(pa.array([None, text, ""]))
    starts, ends = zip(*[(i, i + n) for n in (*range(20), 63, 64, 65, 130) for i in range(0, 260, 7)], strict=True)
    import numpy as np

    got = t.hash_spans(np.array(starts), np.array(ends)).tolist()
    by = {}
    for a, b, h in zip(starts, ends, got, strict=True):
        assert by.setdefault(h, text[a:b]) == text[a:b]
    assert len(by) == len({text[a:b] for a, b in zip(starts, ends, strict=True)})


def test_long_inputs_keep_fewer_levels(monkeypatch):
    import numpy as np

    keys = np.array([(i * i) % 97 for i in range(3000)] + [1, 2, 3] * 900 + [7] * 1500, np.uint64)
    every = quality_rules.longest_repeats(keys)
    monkeypatch.setattr(quality_rules, "DENSE", 10)
    assert every.tolist() == quality_rules.longest_repeats(keys).tolist() and every.max() == 3000 - 97


def key(r):
    return tuple((x is None, x) for x in r)


def test_quality_rules(docs, empty):
    got = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in quality_rules.quality_rules(docs).collect()}
    for i, text, _ in ROWS:
        text = text or ""
        w = WORD.findall(text)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[i, len(w), sum(map(len, w))]
        assert (r["n_repeat_words"], r["n_dup_lines"]) == (len(marked), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(ch in "#*$%&|<>" for ch in text)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
        longest = 0
        if len(w) < 2000:
            for a in range(len(w)):
                for b in range(a):
                    n = 0
                    while a + n < len(w) and w[a + n] == w[b + n]:
                        n += 1
                    longest = max(longest, n)
            assert r["longest_repeat"] == longest
    assert got[5, 60_000, 60_000]["longest_repeat"] == 59_999
    kept = quality_rules.quality_rules(docs, only_kept=True)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {6, 7, 8}
    assert quality_rules.quality_rules(empty).count() == 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(docs, empty, keep_first):
    marks = linededup.keep_bitmaps(docs, min_docs=10, keep_first=keep_first, salts=3)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in linededup.apply_bitmaps(docs, marks).collect()), key=key)
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    where = defaultdict(set)
    for i, text, _ in ROWS:
        for x in (text or "").split("\n"):
            where[norm(x)].add(i)
    hot = {k for k, ids in where.items() if k and len(ids) >= 10}
    seen, want = set(), []
    for i, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, kept = (text or "").split("\n"), []
        for x in lines:
            if norm(x) not in hot or (keep_first and norm(x) not in seen):
                kept.append(x)
            seen.add(norm(x))
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert got == sorted(want, key=key)
    assert linededup.apply_bitmaps(empty, linededup.keep_bitmaps(empty)).count() == 0


def test_line_dedup_of_long_documents(spark):
    """Work is linear in lines: 200 000 of them in each of ten documents, with clashing columns."""
    line = "if(i % 3 = 0, concat('hot ', i), concat('line ', id, ' ', i))"
    df = spark.range(10).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, 200000), i -> {line}), '\n') AS text", "1 AS _id", "2 AS _hash", "3 AS _drops", "4 AS _kept")
    began = time.perf_counter()
    out = linededup.apply_bitmaps(df, linededup.keep_bitmaps(df))
    assert out.columns[:6] == df.columns
    got = out.select("n_lines", "n_dropped", F.size(F.split("kept_text", "\n")).alias("left"), "_id", "_kept").collect()
    assert [tuple(r) for r in got] == [(200_000, 66_666, 133_334, 1, 4)] * 10
    assert time.perf_counter() - began < 120


def test_long_bitmaps(spark):
    text = "\n".join("hot" if i % 3 == 0 else f"line {i}" for i in range(400))
    df = spark.createDataFrame([(i, text.replace("line", f"line{i}")) for i in range(10)], "doc_id long, text string")
    r = linededup.apply_bitmaps(df, linededup.keep_bitmaps(df)).where("doc_id = 4").first()
    assert r["n_dropped"] == 134 and "hot" not in r["kept_text"] and r["kept_text"].count("\n") == 265


def components(rows, width, percent):
    sets = defaultdict(list)
    for i, text, _ in rows:
        w = WORD.findall((text or "").translate(LOW))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        if i is not None:
            sets[i].append(s)
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, empty, width):
    got = minhash.near_duplicates(docs, width, 80).collect()
    assert len(got) == len(ROWS)
    want = components(ROWS, width, 80)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    left = minhash.drop_near_duplicates(docs, width, 80)
    assert left.columns == docs.columns
    once = {(i, text) for i, text, _ in ROWS if i is None or want[i] == i}
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=key) == sorted(once, key=key)
    assert minhash.near_duplicates(empty).count() == 0


def test_equal_ids_with_other_texts(spark):
    b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "bcd")
    rows = [(3, b, 0), (5, b, 0), (5, c, 0), (5, c, 0), (3, d, 0), (9, d + " z", 0), (None, c, 0), (None, c, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int").withColumns({"_text": F.lit(1), "_mark": F.lit(2), "_nth": F.lit(3)})
    got = Counter((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(df, 5, 80).collect())
    assert got == Counter({(3, b): 1, (5, c): 1, (3, d): 1, (None, c): 2})
    named = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 5, 80).collect())
    assert named == Counter({(3, 3, True): 2, (5, 3, False): 1, (5, 5, True): 2, (9, 3, False): 1, (None, None, True): 2})


def test_recall_against_exact_similarity(spark):
    """Pairs at a similarity just above the threshold, each apart from all others."""
    import random

    rng = random.Random(11)
    rows = []
    for k in range(300):
        base = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(60, 200))]
        other = list(base)
        other[rng.randrange(5, 25)] = other[rng.randrange(30, 55)] = "changed"
        rows += [(2 * k, " ".join(base), None), (2 * k + 1, " ".join(other), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 5, 80).collect()}
    want = components(rows, 5, 80)
    linked = [i for i, c in want.items() if c != i]
    assert 50 < len(linked) < 300 and got == want


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicate_families(spark, block, monkeypatch):
    """Chains and stars whose smallest id resembles only some members; with small blocks through rare shingles."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    import random

    rng = random.Random(5)
    rows = []
    for f in range(6):
        base = [f"f{f}v{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(40):
            w = list(base)
            for _ in range(rng.choice((2, 5, 6, 7, 8))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
            rows.append((f * 100 + k, " ".join(w), None))
    shared = " ".join(f"p{i}" for i in range(70))  # a passage that unlike documents share
    rows += [(1000 + k, " ".join(f"o{k}x{j}" for j in range(30 + k % 9)) + " " + shared, None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2, 80).collect()}
    assert got == components(rows, 2, 80)


def test_components_of_long_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i % 100 != 99], "a long, b long")
    got = {r["node"]: r["root"] for r in minhash.components(edges).collect()}
    want = {i: i - i % 100 for i in range(n)} | {n: 200}
    want = {k: v for k, v in want.items() if k in got}
    assert got == want and len(got) >= n


ITEMS = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota!"), (2, "short one"), (3, None), (4, ""), (5, "short one"), (10, "w3 w4 w5 w6 w7 w8 w9 w10 w11")]


def windows_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    n = min(8, len(w))
    return w, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


@pytest.mark.parametrize(("block", "per_pass"), [(3, 2), (5, 8), (10**6, 8)])
def test_decontamination(spark, docs, empty, block, per_pass, monkeypatch):
    """With small blocks the long item is spread over several, and texts are searched in several passes."""
    monkeypatch.setattr(decontam, "PASS_BLOCKS", per_pass)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = spark.createDataFrame(
        [(50, "zz alpha BETA gamma-delta epsilon zeta eta theta iota kappa"), (51, "very Short One short one"), (52, "alpha beta gamma delta epsilon zeta eta"), (53, "short")],
        "doc_id long, text string",
    )
    every = docs.select("doc_id", "text").unionByName(more)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontam.find_contamination(every, items, block_windows=block).collect()), key=key)
    pats = [(str(i), p) for i, t in ITEMS for p in windows_of(t)[1]]
    want = []
    for i, text in [tuple(r) for r in every.collect()]:
        w, hit, found = windows_of(text)[0], set(), set()
        for item, p in pats:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(item)
        want.append((i, len(w), len(hit), tuple(sorted(found)), len(found) >= 2))
    assert got == sorted(want, key=key)
    clean = decontam.find_contamination(docs, items, min_items=1, only_clean=True)
    assert clean.columns == docs.columns and 6 not in {r["doc_id"] for r in clean.collect()}
    assert decontam.find_contamination(empty, items).count() == 0
    assert decontam.find_contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def queue_by_hand(rows, key):
    """Weighted fair queueing, one row after the other: (row, copy) -> words, and targets."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by = defaultdict(list)
    for i, (_, _, src) in enumerate(rows):
        by[src].append(i)
    total = {src: sum(size[i] for i in own) for src, own in by.items()}
    order = sorted(by, key=lambda x: (x is None, x or ""))
    weight = {src: (1, 2, 3)[k % 3] for k, src in enumerate(order)}
    free, goal = set(by), {}
    while free:  # targets over the cap are fixed, the rest is shared again
        left = sum(size) - sum(goal.values())
        level = left / sum(weight[x] for x in free)
        over = {x for x in free if level * weight[x] > 3 * total[x]}
        for x in over or free:
            goal[x] = 3 * total[x] if over else level * weight[x]
        free = free - over if over else set()
    queue = []
    for src, own in by.items():
        at = 0
        for c in range(4):
            for i in sorted(own, key=lambda i: (key(rows[i]), size[i])):
                if size[i] and at < goal[src]:
                    queue.append(((at + size[i]) / goal[src], src is None, src or "", key(rows[i]), c, i))
                at += size[i]
    out, left = defaultdict(int), sum(size)
    for *_, i in sorted(queue):
        out[i] += min(left, size[i])
        left -= min(left, size[i])
    return out, goal, size


def shuffle_key(row):
    i, text, _ = row
    return hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()


def test_mixing(spark, docs, empty, tmp_path):
    taken, goal, size = queue_by_hand(ROWS, shuffle_key)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op2_mix(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=key) == sorted(((r[0], size[i], taken[i]) for i, r in enumerate(ROWS)), key=key)
    assert sum(r["taken"] for r in got) == sum(size) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert {round(r["target"], 6) for r in got} == {round(t, 6) for t in goal.values()}
    emitted = mixing.emit(docs).collect()
    assert mixing.emit(docs).columns == [*docs.columns, "copy", "finish", "take"]
    assert [r["finish"] for r in emitted] == sorted(r["finish"] for r in emitted)
    words = Counter()
    for r in emitted:
        words[r["doc_id"], r["text"]] += r["take"]
    want = Counter()
    for i, n in taken.items():
        want[ROWS[i][0], ROWS[i][1]] += n
    assert words == +want
    assert [tuple(r) for r in emitted] == [tuple(r) for r in mixing.emit(docs).collect()]
    assert mixing.emit(empty).count() == 0 and mixing.emit(docs.where("doc_id < 3")).count() == 0
    assert {r["taken"] for r in got} != {r["size"] for r in got}


def test_mix_comes_from_the_order(spark, docs, monkeypatch):
    """The running total goes along a sort by finish time, and another order gives other amounts."""
    plan = mixing.schedule(docs)
    amounts = lambda: {(r["doc_id"], r["key"], r["nth"], r["copy"]): r["take"] for r in mixing.queued(plan).collect()}
    text = mixing.queued(plan)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [sum(size" in text and "finish" in text[text.index("Window [sum(size") :].split("\n")[0]
    first = amounts()
    monkeypatch.setattr(mixing, "ORDER", ("key", "nth", "copy", "finish"))
    assert amounts() != first


def test_mix_over_many_cells(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), f"s{i % 4}") for i in range(500)] + [(1000, "x " * 3000, "s0"), (1000, "x " * 3000, "s0"), (1000, "x y", "s0")]
    taken, _, _ = queue_by_hand(rows, shuffle_key)
    monkeypatch.setattr(mixing, "CELL_ROWS", 10)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, _key int, key string")
    got = Counter()
    for r in mixing.emit(df).collect():
        got[r["doc_id"], r["text"]] += r["take"]
    want = Counter()
    for i, n in taken.items():
        want[rows[i][0], rows[i][1]] += n
    assert got == +want
    assert mixing.emit(df).columns[:5] == df.columns


@pytest.mark.parametrize("n", range(6))
def test_shingles_of_a_batch_of_few_words(n):
    text = " ".join("abcde"[:n])
    alone = minhash.shingle_sets(Texts(pa.array([text])), 5)
    beside = minhash.shingle_sets(Texts(pa.array([text, "x " * 50])), 5)
    assert len(alone) == 1 and alone[0].tolist() == beside[0].tolist() and len(alone[0]) == (n > 0)


def quality_by_hand(text):
    w = WORD.findall(text or "")
    n = len(w)
    marked = set()
    for size in (3, 10):
        c = Counter(tuple(w[k : k + size]) for k in range(n - size + 1))
        marked |= {(size, k + j) for k in range(n - size + 1) if c[tuple(w[k : k + size])] > 1 for j in range(size)}
    windows, covered = (sum(1 for s, _ in marked if s == size) for size in (3, 10))
    longest = 0
    while len({tuple(w[k : k + longest + 1]) for k in range(n - longest)}) < n - longest:
        longest += 1
    return n >= 50 and 100 * windows <= 50 * n and 100 * covered <= 40 * n and not (longest >= 10 and 100 * longest > 30 * n)


def test_pipeline_by_hand(spark, tmp_path):
    """All stages of the pipeline one after the other in plain Python, with null texts and ids, ties, repeated rows and other columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import random

    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [(1, text(12)), (2, text(5)), (3, None)]
    base = [text(rng.randrange(60, 160)) for _ in range(40)]
    line = text(70)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(50, base[0], "s1"), (51, base[1] + " more", None), (52, base[2] + "\n" + items[0][1], "s2"), (53, None, "s0"), (54, "", "s0"), (None, base[3], "s1"), (None, text(80), None)]
    rows += [(60, base[4], "s1"), (60, base[4], "s1"), (60, base[5] + " " + text(60), "s1"), (61, "again " * 200, "s0"), (62, text(60) + " " + items[1][1] + " " + text(60), "s0")]
    rows += [(100 + i, text(60) + "\n" + line + "\n" + text(60), "s4") for i in range(12)]
    full = [(i, t, "en", s, len(t or ""), 1, 2) for i, t, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _id int, finish int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [r for r in rows if quality_by_hand(r[1])]
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    where, seen, out = defaultdict(set), set(), []
    for i, t, _ in left:
        for x in t.split("\n"):
            where[norm(x)].add(i)
    for i, t, s in sorted(left, key=key):
        lines = [x for x in t.split("\n") if len(where[norm(x)]) < 10 or not norm(x) or not (norm(x) in seen or seen.add(norm(x)))]
        out.append((i, "\n".join(lines), s))
    left = [r for r in out if r[1].strip()]
    named = components([(k, t, s) for k, (i, t, s) in enumerate(left) if i is not None], 5, 80)
    first = {}
    for k, root in named.items():
        first[root] = min(first.get(root, k), k, key=lambda k: (left[k][0], k))
    kept = set(first.values()) | {k for k, r in enumerate(left) if r[0] is None}
    left = [r for k, r in enumerate(left) if k in kept]
    pats = [p for _, t in items for p in windows_of(t)[1]]
    left = [r for r in left if not any(w[k : k + len(p)] == list(p) for w in [windows_of(r[1])[0]] for p in pats for k in range(len(w) - len(p) + 1))]
    taken, _, _ = queue_by_hand(left, shuffle_key)
    want = Counter()
    for k, n in taken.items():
        want[left[k][0], left[k][1]] += n
    got = Counter()
    result = pipeline.run(spark, str(tmp_path))
    for r in result.collect():
        got[r["doc_id"], r["text"]] += r["take"]
    assert got == +want and 20 < len(left) < len(rows) - 5
    spark.createDataFrame(full[:0], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
