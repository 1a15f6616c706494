import hashlib
import itertools
import random
import re

import pytest

from heddle.llm import decontaminate, exact_dedup, near_dedup


def frame(spark, texts):
    return spark.createDataFrame(list(texts), "doc_id long, text string")


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# -- exact --------------------------------------------------------------------------------------


def check_exact(docs, bits=64):
    rows, groups = [(r["doc_id"], r["text"] or "") for r in docs.collect()], {}
    for i, text in rows:
        groups.setdefault(text, []).append(i)
    want = sorted(((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)
    got = exact_dedup.exact_dedup(docs, hash_bits=bits).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted({r["text_sha256"] for r in got})


def test_exact_against_brute_force(spark, odd_documents):
    rng = random.Random(1)
    base = [" ".join(prose(rng, rng.randrange(1, 900))) + "\n" for _ in range(30)]
    texts = base + base[:12] + [b[:-2] + "x" for b in base[:9]] + [b + "\n" for b in base[:3]] + ["", ""]
    check_exact(frame(spark, enumerate(texts)))
    check_exact(odd_documents)


@pytest.mark.parametrize("bits", [1, 4])
def test_exact_with_colliding_hashes(spark, odd_documents, bits):
    check_exact(odd_documents, bits)
    check_exact(frame(spark, enumerate(["a. b" * 300, "b. a" * 300, "a. b" * 300, "c", "", "c"])), bits)


def test_chunks_are_lossless_and_local(spark):
    rng = random.Random(2)
    text = "".join(" ".join(prose(rng, 12)) + rng.choice([". ", ".\n", "! "]) for _ in range(300))
    cut = lambda t: frame(spark, [(1, t)]).select(exact_dedup.chunks(exact_dedup.F.col("text"))).first()[0]
    one, two = cut(text), cut("An inserted sentence. " + text)
    assert "".join(one) == text and len(one) > 20 and len(set(one) - set(two)) <= 3
    assert "".join(cut("x" * 10_000)) == "x" * 10_000


def test_exact_keeps_one_and_all_columns(spark, odd_documents):
    kept = exact_dedup.keep_first(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([2, 4, 5, 6, 7, 8, 9, None], key=repr)


ROWS = [(1, "A"), (1, "B"), (2, "B"), (6, "dup"), (6, "dup"), (None, "C"), (3, "C"), (None, "D"), (None, "D"), (4, None), (4, "")]


def test_exact_drops_rows_not_identifiers(spark, tmp_path):
    want = sorted([(1, "A"), (2, "B"), (6, "dup"), (3, "C"), (None, "D")], key=repr)
    docs = frame(spark, ROWS).withColumn("__n", exact_dedup.F.lit(1)).withColumn("__gone", exact_dedup.F.lit(2))
    docs.write.parquet(f"{tmp_path}/docs")
    for d in (docs, spark.read.parquet(f"{tmp_path}/docs"), docs.unionByName(docs)):
        kept = exact_dedup.keep_first(d)
        assert kept.columns == docs.columns
        rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert sorted([r for r in rows if r[1]], key=repr) == want and [r[0] for r in rows if not r[1]] == [4]


def test_near_drops_rows_not_identifiers(spark):
    a, b, c = (" ".join(prose(random.Random(i), 40)) for i in range(3))
    near = b.rsplit(" ", 1)[0] + " changed"
    docs = frame(spark, [(1, a), (1, b), (2, near), (6, c), (6, c), (None, "one two"), (None, "one two"), (None, "three")])
    kept = sorted(((r["doc_id"], r["text"]) for r in near_dedup.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (6, c), (None, "one two"), (None, "three")], key=repr)


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


# -- near ---------------------------------------------------------------------------------------


def brute_sets(texts):
    out = {}
    for i, t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_classes(texts, share=0.8):
    s = brute_sets(texts)
    label = {i: i for i in s}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] == s[b] or s[a] and s[b] and len(s[a] & s[b]) >= share * max(len(s[a]), len(s[b])) - 1e-9:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {i: find(i) for i in s}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def near_corpus():
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([3, 8, 30, 200, 1500])) for _ in range(60)]
    texts += [edited(rng, texts[i], max(1, len(texts[i]) // 60)) for i in range(40)]
    chain = prose(rng, 300)
    for _ in range(12):  # each is near the one before, the ends aren't near each other
        chain = edited(rng, chain, 4)
        texts.append(chain)
    family = prose(rng, 250)
    texts += [edited(rng, family, rng.randrange(1, 5)) for _ in range(80)]
    passage = prose(rng, 70)
    texts += [[*prose(rng, 60), *passage, *prose(rng, 60)] for _ in range(40)]
    texts += [passage, texts[0], texts[0]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_against_brute_force(spark):
    texts = near_corpus()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(frame(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_near_odd_rows(spark, odd_documents):
    got = [(r["doc_id"], r["class_id"], r["kept"]) for r in near_dedup.near_classes(odd_documents).collect()]
    assert len(got) == 11
    by = {i: c for i, c, _ in got}
    assert by[1] == by[2] == 1 and by[3] == by[4] == 3 and by[6] == 6 and by[None] is None and by[5] == 5 and by[7] == 7
    kept = near_dedup.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 5, 6, 7, 8] + [9] * (by[9] == 9)


def test_near_crowds_and_families(spark):
    """Bands that hundreds share: a passage that all quote, a family of copies whose edges are borderline, copies in great number."""
    rng = random.Random(21)
    passage, base = prose(rng, 60, 10**6), prose(rng, 100, 10**6)
    texts = [[*prose(rng, rng.randrange(8, 60), 10**6), *passage] for _ in range(350)]
    texts += [edited(rng, base, rng.randrange(1, 6)) for _ in range(350)]
    texts += [texts[i] for i in range(0, 700, 7)] + [base] * 300
    rng.shuffle(texts)
    texts = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_classes(texts)
    assert 100 < len(set(want.values())) < 900
    got = near_dedup.near_classes(frame(spark, texts)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(set(want.values()))
    sets = brute_sets(texts)
    for r in got:
        x, y = sets[r["doc_id"]], sets.get(r["linked_to"])
        if y:
            assert want[r["doc_id"]] == want[r["linked_to"]] and len(x & y) >= 0.8 * max(len(x), len(y))
        else:  # the first of its copies, which have no near ones
            assert all(sets[i] == x for i, c in want.items() if c == r["class_id"])


def test_near_reads_wanted_texts_only(spark, tmp_path, monkeypatch):
    texts = near_corpus()
    docs = frame(spark, texts)
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    for d in (spark.read.parquet(f"{tmp_path}/docs"), docs):
        rows = near_dedup._rows(near_dedup.numbered(d, "n"), "n", "doc_id", "text")
        own = rows.where("id % 7 = 3").select("row")
        assert sorted(r["id"] for r in near_dedup.only_rows(rows, own).collect()) == [i for i, _ in texts if i % 7 == 3]
    seen = []
    wanted = near_dedup.only_rows
    monkeypatch.setattr(near_dedup, "only_rows", lambda rows, own: seen.append(own.count()) or wanted(rows, own))
    monkeypatch.setattr(near_dedup, "maybe_broadcast", lambda df, rows: df)  # as if all were too large
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(frame(spark, texts)).collect()}
    assert got == brute_classes(texts) and seen and max(seen) < len(texts)


def test_words_are_those_of_the_pattern():
    texts = ["", " ", "a", "a_b c-d", "été çà  x²½ \U0001d518\U0001d52b 한국어 日本語, ٣٤.", "w" * 3000 + " " + "w" * 3001, "b a b", "".join(map(chr, range(0x3000)))]
    texts = [t.lower() for t in texts]
    words = [re.findall(r"\w+", t) for t in texts]
    hashes, counts = near_dedup.word_hashes(texts)
    flat = list(itertools.chain(*words))
    assert counts.tolist() == [len(w) for w in words] and len(hashes) == len(flat)
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    for t, s in zip(texts, near_dedup.shingle_sets(texts), strict=True):
        assert s.tolist() == near_dedup.shingle_sets([t])[0].tolist() and len(s) == len(brute_sets([(0, t)])[0])


def test_near_empty(spark):
    assert near_dedup.near_classes(frame(spark, [])).count() == 0


def test_banding_is_tuned_to_each_partition():
    for part in range(2, 16):
        j, (bands, rows) = near_dedup.jaccard_bound(part), near_dedup.banding(part)
        assert 0.6 < j <= 1 and (bands == 0 or (1 - j**rows) ** bands <= near_dedup.MISS and bands * rows <= near_dedup.HASHES)
    assert near_dedup.banding(1) == (0, 0)


# -- decontamination ----------------------------------------------------------------------------


def brute_leaks(texts, items, share=0.8):
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    out = set()
    for item, text in items:
        s = shingles(text)
        out |= {(d, item, len(s & shingles(t))) for d, t in texts if s and len(s & shingles(t)) >= share * len(s)}
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(prose(rng, rng.choice([3, 5, 6, 9, 20, 60])))) for i in range(40)]
    texts = []
    for d in range(80):
        words = prose(rng, rng.choice([10, 200, 3000]))
        for _ in range(rng.randrange(3)):
            item = edited(rng, rng.choice(items)[1].split(), rng.randrange(4))
            at = rng.randrange(len(words))
            words[at:at] = item
        texts.append((d, " ".join(words)))
    got = decontaminate.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(texts, items)
    assert {(r["doc_id"], r["item_id"], r["shared"]) for r in got} == want and len(want) > 10 and len(got) == len(want)


def test_leaks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "maybe_broadcast", lambda df, rows: df)
    texts = [(1, "zero one two three four five six seven"), (2, "nothing to see in this text"), (3, None)]
    items = spark.createDataFrame([(7, "One two, three FOUR five six!"), (8, "too short"), (9, None), (None, "nothing to see in this text")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["containment"]) for r in decontaminate.contaminated(frame(spark, texts), items).collect()}
    assert got == {(1, 7, 1.0), (2, None, 1.0)}


def test_leaks_odd_rows(spark, odd_documents):
    items = spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta"), (1, "beta gamma delta epsilon zeta eta")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd_documents, items).collect()} == {(1, 1), (2, 1)}
    kept = decontaminate.without_leaks(odd_documents, items)
    assert kept.columns == odd_documents.columns and kept.count() == 9
    assert decontaminate.contaminated(odd_documents.where("false"), items).count() == 0 and decontaminate.contaminated(odd_documents, items.where("false")).count() == 0


def test_one_crowded_band_suffices(spark, monkeypatch):
    rng = random.Random(8)
    texts, linked = [], []
    for i in range(60):  # pairs that share 0.8 to 0.82 of the larger set
        words = prose(rng, 104, 10**6)
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:84], *prose(rng, 20, 10**6)]))]
        linked.append((2 * i, 2 * i + 1))
    want = brute_classes(texts)
    assert all(want[a] == want[b] for a, b in linked)
    monkeypatch.setattr(near_dedup, "bands", lambda shingles, share: [7])  # one band, which all documents are in
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(frame(spark, texts)).collect()}
    assert got == want
