"""SimHash groups, connected components and decontamination against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from bizmetrics.llm import components, decontaminate, simhash
from conftest import rows

DOCS = "doc_id bigint, text string, key string, fp string, ROOT int"


def docs(spark, *pairs):
    return spark.createDataFrame([(i, t, "k", "f", 1) for i, t in pairs], DOCS)


def plain_print(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(table, bits=2):
    prints = [plain_print(t) for _, t in table]
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(table)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(table):
        ids.setdefault(find(i), []).append(d)
    names = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return [(d, f"{prints[i]:016x}", names[find(i)]) for i, (d, _) in enumerate(table)]


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}É" for i in range(400)]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 3, 5, 40, 200]))) for _ in range(n)]
    for _ in range(n):
        source = rnd.choice(texts).split()
        if source:
            source[rnd.randrange(len(source))] = rnd.choice(words)
        texts.append((rnd.choice([" ", "\n", "\t  "])).join(source).swapcase() if rnd.random() < .3 else " ".join(source))
    table = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    return table + [(None, texts[0]), (None, None), (5000, None), (5001, ""), (5002, " \n"), table[3], table[3], (5003, "x " * 40_000),
                    (5004, "\x1c\u00a0 a b"), (5005, "Ä A")]


def test_simhash_is_brute_force(spark):
    table = corpus()
    got = simhash.near_duplicates(docs(spark, *table))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(rows(got), key=repr) == sorted(plain_groups(table), key=repr)


@pytest.mark.parametrize("small", [simhash.SMALL_BUCKET, 1])
def test_links_of_planted_bits(spark, monkeypatch, small):
    """Chains over one and two bits in every block, found by either way to search a bucket."""
    rnd = random.Random(3)
    prints = {rnd.getrandbits(64) for _ in range(300)}
    for p in list(prints):
        for b in rnd.sample(range(64), 2):
            p ^= 1 << b
        prints.add(p)
    prints = sorted(prints)
    arr = np.array(prints, np.uint64)
    root = simhash._forest(arr, np.array([sum(c) for k in (1, 2) for c in combinations([1 << b for b in range(64)], k)], np.uint64), 2) \
        if small > 1 else None
    if small > 1:
        monkeypatch.setattr(simhash, "SMALL_BUCKET", 1)
        flips = np.array([sum(c) for k in (1, 2) for c in combinations([1 << b for b in range(64)], k)], np.uint64)
        assert (simhash._forest(arr, flips, 2) == root).all()
        return
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    linked = {r.node: r.root for r in simhash.fingerprint_components(frame).collect()}
    signed = arr.view(np.int64)
    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            assert linked[signed[i]] == linked[signed[j]]
    near = {int(signed[i]) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2 for i in (i, j)}
    assert set(linked) == near


def test_one_of_each_group_stays(spark):
    table = corpus(2)
    kept = simhash.drop_near_duplicates(docs(spark, *table))
    assert kept.columns == ["doc_id", "text", "key", "fp", "ROOT"]
    groups = {}
    for (d, t), (_, _, name) in zip(table, plain_groups(table)):
        groups.setdefault(name, []).append((d is None, d, t))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g, key=lambda x: (x[0], x[1]))[1] for g in groups.values())
    assert rows(simhash.near_duplicates(docs(spark, *table).limit(0))) == []
    assert simhash.drop_near_duplicates(docs(spark, *table).limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, None), (3, 3)]
    edges += [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    neighbours = {}
    for a, b in edges:
        if None not in (a, b) and a != b:
            neighbours.setdefault(a, set()).add(b)
            neighbours.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(neighbours):
        stack = [node]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = node
                stack += neighbours[x]
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def plain_leaks(table, items):
    import re
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for d, text in set(table):
        words = cut(text)
        for item, passage in set(items):
            p = cut(passage)
            if not p:
                continue
            k = min(5, len(p))
            shingles = {tuple(p[i:i + k]) for i in range(len(p) - k + 1)}
            found = shingles & {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
            if len(found) >= 0.8 * len(shingles) - 1e-9:
                out.add((d, item, len(shingles), len(found)))
    return out


def test_decontamination_is_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 2, 4, 5, 6, 9, 14, 40, 90])))) for i in range(30)]
    items += [(None, items[3][1] + " more words of it here"), (77, None), (78, "?!"), items[0], (79, "w1 " * 30)]
    table = []
    for i in range(150):
        text = rnd.choices(words, k=rnd.choice([0, 3, 30, 400]))
        passage = (rnd.choice(items)[1] or "").split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            if passage:
                passage[rnd.randrange(len(passage))] = "changed"
        text[len(text) // 2:len(text) // 2] = [w.title() + "," for w in passage]
        table.append((i, " ".join(text)))
    table += [(None, table[0][1]), (500, None), (501, ""), table[5], table[5], (502, "w1 " * 20_000)]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, key int")
    frame = docs(spark, *table)
    got = decontaminate.contaminated(frame, bench)
    want = plain_leaks(table, items)
    assert len(want) > 60
    assert sorted(map(repr, ((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got.collect()))) == sorted(map(repr, want))
    dirty = {(d, t) for d, t in table if any(x[0] == d for x in want)}
    left = decontaminate.drop_contaminated(frame, bench)
    assert left.columns == frame.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left.collect()))) == sorted(repr(x) for x in table if x not in dirty)
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(frame, bench.limit(0)).count() == len(table)


def test_a_text_with_many_items_costs_no_more(spark):
    """One text of 20,000 words: hundreds of items in it take little longer than two."""
    import time
    words = [f"w{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")
    items = lambda n: spark.createDataFrame([(i, " ".join(words[i * 30:i * 30 + 30])) for i in range(n)], "item_id int, text string")
    took = {}
    for n in (2, 600, 2, 600):
        began = time.time()
        found = decontaminate.contaminated(docs, items(n)).collect()
        took[n] = time.time() - began
        assert sorted((r.item_id, r.n_found, r.containment) for r in found) == [(i, 26, 1.0) for i in range(n)]
    assert took[600] < 1.5 * took[2] + 2


def test_decontamination_stays_in_the_jvm(spark):
    plan = decontaminate.contaminated(docs(spark, (1, "a b c d e f")), spark.createDataFrame([(1, "a b c d e f")], "item_id int, text string"))
    assert not __import__("re").search("Python|Arrow|Pandas", plan._jdf.queryExecution().toString())
