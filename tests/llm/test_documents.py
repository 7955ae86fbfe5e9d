"""The document operators against plain versions, on given tables and on odd rows."""

import random

import duckdb
import pytest
from conftest import SF_DIR
from llm import brute

from pagedrift.llm import jobs, merkle, quality, repeats, secrets, simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def prose(n, seed):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(50)) for _ in range(n))


SHARED = prose(60, 1)
LONG = "\n".join(f"{prose(12, i)}." for i in range(3000))
ODD = [
    (1, f"{prose(30, 2)} {SHARED} {prose(30, 3)}"),
    (2, f"{prose(20, 4)} {SHARED} {prose(9, 5)} {SHARED}"),
    (3, None), (4, ""), (5, " \t\n\x0b"), (6, "one"), (7, "One two"), (8, "ha " * 400), (9, "a" * 5000),
    (10, LONG), (11, LONG[200:90000]), (12, "é世\U0001f600" * 200), (13, "x y " * 40), (14, SHARED), (15, SHARED),
    (16, "x\r\n" * 100), (-3, f"{SHARED} token: abcdef1234 {prose(5, 7)}"),
]


@pytest.fixture(scope="module")
def given():
    return duckdb.sql(f"select doc_id, text from '{SF_DIR}/documents.parquet'").fetchall()


def by_id(spark, name, folder):
    rows = [r.asDict() for r in jobs.QUERIES[name](spark, folder).collect()]
    return {r["doc_id"]: r for r in rows}, len(rows)


def check(spark, name, folder, docs, expected):
    found, n = by_id(spark, name, folder)
    assert n == len(docs)
    for doc_id, values in expected.items():
        assert {c: found[doc_id][c] for c in values} == values, doc_id


def named(rows, *columns):
    return {i: dict(zip(columns, v)) for i, v in rows.items()}


def expected(name, docs):
    if name == "op1_merkle":
        return named(brute.edited_digests(docs), "n_chars", "edited_sha256")
    if name == "op2_secrets":
        out = {}
        for doc_id, text in docs:
            found = brute.secrets(text)
            counts = {f"n_{k}": sum(x[2] == k for x in found) for k, _ in brute.KINDS}
            out[doc_id] = {**counts, "base_sha256": brute.sha(",".join(f"{k}:{s}:{e}" for s, e, k in found))}
        return out
    if name == "op5_bwt":
        return named(brute.repeated_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    if name == "op6_suffix_tree":
        return named(brute.repeated_words(docs), "n_words", "n_removed", "kept_sha256")
    prints = brute.fingerprints(docs)
    parts = brute.components(prints)
    return {i: {"fingerprint": f"{prints[i]:016x}", "component_id": parts[i]} for i in prints}


NAMES = ("op1_merkle", "op2_secrets", "op5_bwt", "op6_suffix_tree", "op7_simhash")


@pytest.mark.parametrize("name", NAMES)
def test_given_tables(spark, given, name):
    check(spark, name, SF_DIR, given, expected(name, given))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, tables, name):
    check(spark, name, tables(documents=ODD), ODD, expected(name, ODD))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table_null_ids_and_repeated_rows(spark, tables, name):
    assert jobs.QUERIES[name](spark, tables()).collect() == []
    rows = [(None, SHARED), (None, SHARED), (4, SHARED), (4, SHARED), (None, None), (5, prose(200, 9))]
    found = jobs.QUERIES[name](spark, tables(documents=rows)).collect()
    assert len(found) == len(rows)
    if name in ("op5_bwt", "op6_suffix_tree"):
        # Null comes first; rows of one id are one place.
        removed = sorted((r["doc_id"] is None, r["n_removed"] > 0) for r in found)
        assert removed == [(False, False), (False, True), (False, True), (True, False), (True, False), (True, False)]


@pytest.mark.parametrize("name", ("op5_bwt", "op6_suffix_tree"))
def test_hot_anchors_are_dealt_by_windows(spark, tables, monkeypatch, name):
    monkeypatch.setattr(repeats, "MOST_CLASSES", 3)
    monkeypatch.setattr(repeats, "BLOCK", 400)
    docs = [(i, f"{prose(8, 100 + i)} {SHARED} {prose(8, 200 + i)}") for i in range(40)]
    check(spark, name, tables(documents=docs), docs, expected(name, docs))


def test_many_texts_without_an_id(spark, tables):
    import xxhash

    common = [prose(40 + 7 * i, 900 + i) for i in range(12)]
    texts = [f"{prose(3 + i % 50, 3000 + i)} {common[i % 12]} {prose(i % 9, 9000 + i)}" for i in range(900)]
    docs = [(None, t) for t in texts] + [(1, common[0]), (2, f"{common[1]} x {common[2]}"), (3, f"x {common[0]}")]
    folder = tables(documents=docs)
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    # Texts without an id come first, in the order of their hash.
    order = [*sorted(texts, key=signed), *[t for _, t in docs[-3:]]]
    want = sorted(brute.repeated_bytes(list(enumerate(order))).values())
    rows = jobs.QUERIES["op5_bwt"](spark, folder).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == want
    # For words they are one document, that comes before the others.
    rows = jobs.QUERIES["op6_suffix_tree"](spark, folder).collect()
    assert len(rows) == len(docs) and not any(r["n_removed"] for r in rows if r["doc_id"] is None)
    assert {r["doc_id"]: r["n_words"] - r["n_removed"] for r in rows if r["doc_id"]} == {1: 0, 2: 1, 3: 1}


@pytest.mark.parametrize("name", ("op5_bwt", "op6_suffix_tree"))
def test_many_equal_rows_leave_their_anchor_whole(spark, tables, monkeypatch, name):
    monkeypatch.setattr(repeats, "BLOCK", 1000)  # few classes, but rows of one beyond three blocks
    docs = [(i, f"{prose(6, 10 * i)} {' '.join(SHARED.split()[i:])} {prose(6, 700 + i)}") for i in range(12)]
    want = expected(name, docs)
    folder = tables(documents=[docs[0]] * 300 + docs[1:6] + [docs[6]] * 300 + docs[7:])
    rows = jobs.QUERIES[name](spark, folder).collect()
    assert len(rows) == 610
    for r in rows:
        assert {c: r[c] for c in want[r["doc_id"]]} == want[r["doc_id"]]


def test_tiles_cover_each_window_once():
    import numpy as np

    kind = repeats.Kind(window=20, gram=6, words=False)
    values = kind.values(prose(100, 3).encode())
    start, n, *_ = repeats.tiles(values, np.array([len(values)]), kind)
    assert [s + i for s, k in zip(start, n) for i in range(k)] == list(range(len(values) - 19))


# --- fingerprints ----------------------------------------------------------------------------

def test_merkle_tells_where_texts_differ(spark):
    before = [(1, "One a. Two b.\n\nThree c.\nFour d."), (2, "same")]
    after = [(1, "One a. Two b.\n\nThree x.\nFour d."), (2, "same")]
    frame = lambda rows: merkle.trees(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r["doc_id"], r["side"], r["start"], r["length"]) for r in merkle.edits(frame(before), frame(after)).collect()}
    assert found == {(1, "before", 15, 8), (1, "after", 15, 8)}


def test_merkle_likeness(spark, given):
    texts = [t for _, t in given if t]
    roots = {merkle.Tree(t).root for t in texts}
    assert len(roots) == len(set(texts))
    found, _ = by_id(spark, "op1_merkle", SF_DIR)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found.values())
    assert sum(r["near_edited"] for r in found.values()) > 50 * sum(r["near_next"] for r in found.values())
    tree = merkle.Tree("a. b.\nc.")
    assert merkle.likeness(tree, merkle.Tree("a. b.\nc.")) == 1.0
    assert merkle.likeness(merkle.Tree(""), merkle.Tree("")) == 1.0
    assert merkle.likeness(tree, merkle.Tree("")) == 0.0


def test_merkle_likeness_goes_down_in_order():
    like = lambda a, b: merkle.likeness(merkle.Tree(a), merkle.Tree(b))
    lines = [f"{prose(8, i)}. {prose(9, 50 + i)}." for i in range(60)]
    text = "\n".join(lines)
    # What moves counts less than what stays, and only equal texts are wholly alike.
    assert 0.4 < like(text, "\n".join(lines[30:] + lines[:30])) < 0.6
    assert like(text, "\n".join(reversed(lines))) < 0.2
    assert 0.9 < like(text, text.replace(lines[7], "Another line.")) < 1
    half = lines[5].split(". ")[0] + ". Another end."
    assert like(text, text.replace(lines[5], "x")) < like(text, text.replace(lines[5], half)) < 1
    assert 0.4 < like(text, merkle.edited(text, prose(500, 9))) < 0.6
    assert 0 < like("\n\n", "\n\n\n\n") < 1 and like("\n\n", "\n\n") == 1.0
    for a, b in ((text, "\n".join(lines[::2])), ("a. b. a. b.", "b. a."), ("", "x"), ("x\ny", "y\nx")):
        assert like(a, b) == like(b, a)


def test_equal_branches_in_order():
    pick = random.Random(3)
    for _ in range(200):
        a, b = ([pick.choice(b"abcd") for _ in range(pick.randrange(9))] for _ in range(2))
        found = merkle.in_order(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_edits_of_odd_ids(spark):
    frame = lambda rows: merkle.trees(spark.createDataFrame(rows, "doc_id long, text string"))
    before = [(None, "one\ntwo"), (1, "same"), (1, "same"), (2, "gone"), (4, None)]
    after = [(None, "one\n2"), (1, "same"), (3, "new"), (4, "")]
    found = {(r["doc_id"], r["side"], r["start"], r["length"]) for r in merkle.edits(frame(before), frame(after)).collect()}
    assert found == {(None, "before", 4, 3), (None, "after", 4, 1)}


def test_one_id_in_many_ranges(spark, tables):
    docs = [(None, f"text {i}. {prose(5, i)}") for i in range(300)] + [(7, "the same text")] * 200 + [(8, "x")]
    rows = [r.asDict() for r in jobs.QUERIES["op1_merkle"](spark, tables(documents=docs)).collect()]
    assert len(rows) == len(docs) and sum(r["doc_id"] is None for r in rows) == 300
    same = [r for r in rows if r["doc_id"] == 7]
    assert sum(r["near_next"] == 1.0 for r in same) == 199 and len({r["fingerprint"] for r in same}) == 1


# --- secrets ---------------------------------------------------------------------------------

def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == {frozenset({"abc", "bcd"})}
    assert q("(abc|xyz)d?") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert q("[0-9a-f]{24,}") == secrets.ANY
    assert q("ab(c|.)") == secrets.ANY
    assert q("(?i:ABC)x*def") == {frozenset({"abc", "def"})}
    assert q("a[bc]d") == {frozenset({"abd"}), frozenset({"acd"})}
    assert q("(abc)+") == {frozenset({"abc"})}


def test_planted_secrets(spark, tables):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    texts = [
        f"x {key} y", "AKIA" + "A" * 15, "Password = 'hunter2a' secret:abc token:\"AbCdEf+/=\" é tokenx=abcdefg",
        "api_key=1234567 APIKEY: 7654321 api-key=1234567", "deadbeef" * 3, "deadbeef" * 3 + "g" + "0" * 24, "DEADBEEF" * 3,
        "password=token:abcdef", "token=ab token=abcdef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20,
        "\U0001f600 token=\n secret  :  zzzzzz", key.lower(), "ſecret=abcdefg", "toKen=abcdefg",
    ]
    docs = list(enumerate(texts))
    want = expected("op2_secrets", docs)
    check(spark, "op2_secrets", tables(documents=docs), docs, want)
    assert all(sum(w[c] for w in want.values()) > 1 for c in ("n_assign", "n_hex")) and want[0]["n_access"] == 1
    found, _ = by_id(spark, "op2_secrets", tables(documents=docs))
    assert found[9]["spans"] == "private:0:31" and "github:0:44" in found[10]["spans"]


def test_secrets_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    rows = sorted(tuple(r) for r in jobs.QUERIES["op2_secrets"](spark, folder).collect())
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = sorted(duck.execute(secrets.OP2_SQL).fetchall())
    assert rows == want and sum(r[1] for r in rows) > 5


# --- near-duplicates -------------------------------------------------------------------------

def test_unequal_thresholds_find_every_neighbour():
    import numpy as np

    pick = np.random.default_rng(3)
    base = pick.integers(0, 1 << 63, 400, dtype=np.uint64)
    base[100:] = base[0] & ~np.uint64(0xFFFF) | base[100:] & np.uint64(0xFFFF)  # three parts alike
    groups = [list(range(16 * p, 16 * p + 16)) for p in range(4)]
    values = simhash.part_values(base, groups)
    within = np.zeros((4, 1 << 16, 4), np.int64)
    for p in range(4):
        for v in np.unique(values[:, p]):
            gap = np.bitwise_count((values[:, p] ^ v).astype(np.uint64))
            within[p, v] = [(gap <= r).sum() * 1000 for r in range(4)]
    limits = simhash.thresholds(within, values, 3)
    assert (limits.sum(axis=1) == 0).all() and limits.min() >= -1 and (limits != 0).any()


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    docs = [(i, f"{SHARED} {prose(200, 11)} w{i % 30}") for i in range(60)] + [(100 + i, prose(40, i)) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    prints = brute.fingerprints(docs)
    want = brute.components(prints)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame).collect()}
    assert found == want and len(set(want.values())) < 70
    kept = simhash.one_of_each(frame.union(frame)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_near_copies_of_the_pipeline(spark, given):
    import corpus_pipeline

    docs = []
    for i in range(40):  # copies with 0 to 9 changed words of 300
        words = prose(300, 500 + i).split()
        pick = random.Random(i)
        for k in range(4):
            changed = list(words)
            for at in pick.sample(range(300), 3 * k):
                changed[at] = "changed"
            docs.append((10 * i + k, " ".join(changed)))
    for rows in (docs, [*ODD, *given]):
        rows = list(dict(rows).items())
        want = set(brute.components(brute.fingerprints(rows)).values())
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        kept = [r["doc_id"] for r in corpus_pipeline.deduplicate(spark, frame, "").collect()]
        assert sorted(kept) == sorted(want) and len(want) < len(rows)


# --- quality ---------------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = model.scores(docs).join(labels.where("doc_id % 2 = 1").select("doc_id", "quality", labels["toxic"].alias("bad")), "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1 and r["bad"] == 0]
    junk = [r["keep"] for r in rows if r["quality"] == 0]
    toxic = [r["keep"] for r in rows if r["bad"] == 1]
    assert sum(good) / len(good) > 0.99 and sum(junk) / len(junk) < 0.05 and sum(toxic) / len(toxic) < 0.08


def test_quality_of_odd_rows(spark, tables):
    rows = [(1, None), (2, ""), (None, "you idiot, you moron, stupid trash"), (4, "A plain sentence of words."),
            (4, "A plain sentence of words."), (5, "BUY!! NOW!! " * 40), (6, LONG)]
    folder = tables(documents=rows, labels=[(4, 1, 0), (4, 1, 0), (None, 1, 1), (5, None, None), (99, 0, 1)])
    found = sorted((r["doc_id"] or 0, r["keep"]) for r in jobs.QUERIES["op10_quality"](spark, folder).collect())
    assert found == [(0, False), (1, True), (2, True), (4, True), (4, True), (5, False), (6, True)]
    assert jobs.QUERIES["op10_quality"](spark, tables()).collect() == []


def test_estimates_tell_good_from_bad_labellers():
    import numpy as np

    pick = np.random.default_rng(1)
    bad = pick.random(20000) < 0.15
    rates = [(0.7, 0.01), (0.5, 0.005), (0.9, 0.05), (0.3, 0.02)]
    bits = sum((pick.random(20000) < np.where(bad, a, b)).astype(int) << i for i, (a, b) in enumerate(rates))
    patterns, n = np.unique(bits, return_counts=True)
    found = quality.estimate(patterns, n.astype(float), 4)
    assert abs(found.prior - 0.15) < 0.02
    assert all(abs(x - a) < 0.06 for x, (a, _) in zip(found.bad, rates))
