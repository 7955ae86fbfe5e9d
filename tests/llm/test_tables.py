"""WARC, decontamination, sharding, mixing and the pipeline."""

import gzip
import io
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from conftest import SF_DIR

import corpus_pipeline
from pagedrift.llm import decontaminate, jobs, mixing, sharding, warc
from pagedrift.llm.common import prepare, ranked, running

# --- WARC ------------------------------------------------------------------------------------


def test_warc_against_sql(spark, tables):
    big, small = "é" * 600, "x" * 999
    pages = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3\r\nX: y", big), (4, "u", small), (5, "u", small),
             (6, "u", None), (7, "u", ""), (None, "u", "z" * 1200), (9, "u", "HTTP\r\n\r\nbody" * 200), (10, "u", "y" * 1000)]
    for folder, rows in ((SF_DIR, None), (tables(pages=pages), pages)):
        found = jobs.QUERIES["op9_warc"](spark, folder)
        duck = duckdb.connect()
        source = f"{folder}/pages.parquet" + ("/*.parquet" if rows else "")
        duck.execute(f"create view pages as select * from '{source}'")
        want = duck.execute(warc.OP9_SQL)
        names = [c[0] for c in want.description]
        assert sorted(map(str, (tuple(r[c] for c in names) for r in found.collect()))) == sorted(map(str, want.fetchall()))
    assert jobs.QUERIES["op9_warc"](spark, tables()).collect() == []


def records(n):
    return [
        {"warc_type": ("response", "metadata")[i % 2], "record_id": f"urn:r:{i}", "target_uri": f"http://h/{i}",
         "content_type": "text/plain", "payload": bytes([i % 251]) * (i * 37), "headers": {"X-N": str(i)}}
        for i in range(n)
    ]


@pytest.mark.parametrize("form", ("plain", "gzip members", "members with lengths", "one gzip member"))
def test_reads_all_forms_and_skips_payloads(spark, tmp_path, form):
    raw = [warc.encode_row(r) for r in records(60)]
    data = {
        "plain": b"".join(raw), "gzip members": b"".join(map(gzip.compress, raw)),
        "members with lengths": b"".join(map(warc.compress_member, raw)), "one gzip member": gzip.compress(b"".join(raw)),
    }[form]
    if form != "plain":
        assert gzip.decompress(data) == b"".join(raw)
    name = tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")
    name.write_bytes(data)
    prepare(spark)
    warc.register(spark)
    rows = spark.read.format("warc").option("path", str(tmp_path)).load()
    found = {r["record_id"]: r for r in rows.collect()}
    assert {k: bytes(r["payload"]) for k, r in found.items()} == {r["record_id"]: r["payload"] for r in records(60)}
    assert found["urn:r:7"]["headers"]["x-n"] == "7" and found["urn:r:7"]["payload_length"] == 7 * 37
    some = rows.where("warc_type = 'metadata' and target_uri in ('http://h/3', 'http://h/4') and payload_length > 5")
    assert [r["record_id"] for r in some.collect()] == ["urn:r:3"]
    bare = spark.read.format("warc").option("path", str(tmp_path)).option("payload", "false").load()
    assert bare.where("payload is null and content_length > 0").count() == 60


def test_filters_reach_the_reader_and_unwanted_payloads_stay_packed():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader({"path": "/nowhere"})
    other = GreaterThan(("payload",), b"x")
    assert list(reader.pushFilters([EqualTo(("warc_type",), "response"), other])) == [other]
    assert [p[:2] for p in reader.pushed] == [("warc_type", "EqualTo")]

    class Counting(pa.BufferReader):
        pass

    import random
    noise = random.Random(1).randbytes(400_000)
    data = warc.compress_member(warc.encode_row({"warc_type": "resource", "record_id": "a", "payload": noise}))
    data += warc.compress_member(warc.encode_row({"warc_type": "response", "record_id": "b", "payload": b"hi"}))
    taken = []

    class Handle(io.BytesIO):
        def size(self):
            return len(data)

        def read(self, n=-1):
            out = super().read(n)
            taken.append(len(out))
            return out

    wanted = lambda h: h["warc-type"] == "response"
    assert [p for _, p in warc.read_records(Handle(data), wanted, True)] == [b"hi"]
    assert sum(taken) < 60_000 < len(data)


def test_failed_attempts_are_not_read(spark, tmp_path):
    writer = warc.WarcWriter({"path": str(tmp_path)}, False)
    batch = pa.RecordBatch.from_pylist([{"warc_type": "resource", "record_id": "x", "payload": b"1"}])
    writer.write(iter([batch]))  # an attempt that is lost
    writer.commit([writer.write(iter([batch]))])
    warc.register(spark)
    assert spark.read.format("warc").option("path", str(tmp_path)).load().count() == 1


# --- decontamination -------------------------------------------------------------------------

ITEM = "A train leaves Boston at 9 with 120 people and after 45 km another 120 people leave so Maria counts 30 people"
SAME = ITEM.replace("120", "77").replace("45", "8,5").replace("30", "12").replace("Boston", "Denver").replace("Maria", "Ines")
MIXED = ITEM.replace("120", "77", 1).replace("45", "8").replace("30", "12")


def leaks(spark, folder):
    return {(r["doc_id"], r["item_id"]) for r in jobs.QUERIES["op3_decontaminate"](spark, folder).collect()}


def test_reparameterised_questions(spark, tables):
    text = "some words before it and after that nothing of note happened here"
    docs = [
        (1, ITEM), (2, f"{text} {SAME} {text}"), (3, MIXED), (4, text), (5, None), (6, ""), (None, SAME),
        (8, f"{text}. {ITEM.upper()}"), (9, ITEM.replace(" ", "\n")), (9, ITEM.replace(" ", "\n")), (10, f"{text} " * 3000 + SAME),
        (11, " ".join(ITEM.split()[:12])), (12, "12 13 14 15 16 17 18 19"), (13, ITEM.replace("people", "folk")),
    ]
    items = [(1, ITEM), (2, None), (3, "too short"), (4, "1 2 3 4 5 6"), (4, "1 2 3 4 5 6")]
    folder = tables(documents=docs, benchmark=items)
    assert leaks(spark, folder) == {(1, 1), (2, 1), (None, 1), (9, 1), (10, 1), (12, 4)}
    left = corpus_pipeline.clean(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([3, 4, 5, 6, 8, 11, 13])
    assert leaks(spark, tables()) == set() == leaks(spark, tables(documents=docs))


def test_fillings_may_coincide(spark, tables):
    item = "a shop sells 3 apples and 5 pears so that Ann pays Bob for all of the fruit on that day"
    docs = [(1, item.replace("3", "4").replace("5", "4")), (2, item.replace("Ann", "Eve").replace("Bob", "Eve")), (3, MIXED)]
    twice = "there are 2 apples in one very large and heavy old box of wood that stands by the wall next to 2 pears"
    docs += [(4, twice.replace("2", "3", 1).replace("2", "5")), (5, twice.replace("2", "7"))]
    long = " and ".join(["so many plain words without a number follow here that"] * 1 + [twice, "some more of them come at the end as well to be whole"])
    docs += [(6, long.replace("2", "3", 1).replace("2", "5"))]
    folder = tables(documents=docs, benchmark=[(1, item), (2, ITEM), (3, long)])
    assert leaks(spark, folder) >= {(1, 1), (2, 1), (6, 3)} and not any(d == 3 for d, _ in leaks(spark, folder))


def test_numbers_in_words(spark, tables):
    item = ("A farmer sold twelve dollars worth of eggs in fifty minutes to three kids. The second kid paid "
            "four dollars and the third kid paid 2 dollars more than Mary did on that day")
    other = item
    for a, b in (("twelve", "Thirty"), ("fifty", "9"), ("three", "seven"), ("third", "fifth"), ("four", "12"), ("Mary", "Jane")):
        other = other.replace(a, b)
    apart = "The tone of the bone was often heard by someone who had been there for a while on that day"
    docs = [(1, other), (2, f"It says here: {other.lower()}"), (3, f"{apart} " * 3), (4, item.replace("eggs", "milk").replace("kid", "man"))]
    assert leaks(spark, tables(documents=docs, benchmark=[(1, item), (2, apart.replace("tone", "stone"))])) >= {(1, 1)}
    found = leaks(spark, tables(documents=docs, benchmark=[(1, item)]))
    assert found & {(1, 1), (3, 1), (4, 1)} == {(1, 1)}


def test_names_anywhere_and_in_lower_case(spark, tables):
    item = ("Tom has 5 apples. Tom buys 3 more of them at the store. Then Tom, Jerry and Spike eat 4. "
            "\"Maria\" counts 7 (Ines, 2) and asks: How many apples are left for Tom?")
    other = item
    for a, b in (("Tom", "Ahmed"), ("Jerry", "Lee"), ("Spike", "Noor"), ("Maria", "Olga"), ("Ines", "Pia"), ("5", "9")):
        other = other.replace(a, b)
    swapped = other.replace("Ahmed", "Tom", 1)
    docs = [(1, item), (2, other), (3, f"He said: {other} And so on."), (4, item.lower()), (5, "so " + item[0].lower() + item[1:]),
            (6, "Tom has a dog. Then Jerry and Spike sleep. How many are left for Tom?"), (7, swapped)]
    found = leaks(spark, tables(documents=docs, benchmark=[(1, item)]))
    assert {d for d, _ in found} - {7} == {1, 2, 3, 4, 5}


def test_long_parts_and_single_changed_words(spark, tables):
    item = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(59))
    small = " ".join(f"v{chr(97 + i)}" for i in range(20))
    w, v = item.split(), small.split()
    docs = [(1, " ".join(w[:45])), (2, f"before it {' '.join(w[20:50])} after it"), (3, " ".join(w[:14])), (4, " ".join(w[30:44]) + " x " + " ".join(w[:14])),
            (11, " ".join([*v[:9], "other", *v[10:]])), (12, " ".join([*v[:2], "other", *v[3:]])), (13, " ".join([*v[:9], "more", *v[9:]])),
            (14, " ".join([*v[:6], "x", *v[7:13], "y", *v[14:]])), (15, " ".join(v[:12]))]
    found = leaks(spark, tables(documents=docs, benchmark=[(1, item), (2, small)]))
    assert found == {(1, 1), (2, 1), (11, 2), (12, 2), (13, 2)}


def test_benchmark_passages_of_given_tables(spark, monkeypatch):
    duck = duckdb.connect()
    want = set(duck.execute(f"""select doc_id, item_id from '{SF_DIR}/documents.parquet' d, '{SF_DIR}/benchmark.parquet' b
      where contains(d.text, b.text)""").fetchall())
    assert want and want <= leaks(spark, SF_DIR)
    from pagedrift.llm import common
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # the way without a broadcast
    assert want <= leaks(spark, SF_DIR)


# --- sharding --------------------------------------------------------------------------------

def placed(spark, folder):
    return [r.asDict() for r in jobs.QUERIES["op4_sharding"](spark, folder).collect()]


def test_shards_are_even_and_hold_groups_together(spark, tables):
    # A third of all rows in one group, pairs, and single rows.
    docs = [(i, "hot") for i in range(400)] + [(400 + i, f"pair {i // 2}") for i in range(400)]
    docs += [(800 + i, f"single {i}") for i in range(395)] + [(1300, None), (1301, None), (1302, ""), (None, "hot"), (5, "hot")]
    rows = placed(spark, tables(documents=docs))
    assert len(rows) == len(docs)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    shards = {}
    text = dict(docs)
    for r in rows:
        shards.setdefault(text.get(r["doc_id"]), set()).add(r["shard"])
    pairs = [s for t, s in shards.items() if t and t.startswith("pair")]
    assert len(shards["hot"]) <= 9 and sum(len(s) == 1 for s in pairs) >= 0.95 * len(pairs)
    one = next(r for r in rows if r["doc_id"] == 400)
    assert (one["size"], one["law"], one["grown_shard"]) == (14, "rows", None)
    assert next(r for r in rows if r["doc_id"] == 1300)["size"] == 8


def test_few_rows_and_only_pairs(spark, tables):
    assert placed(spark, tables()) == []
    few = placed(spark, tables(documents=[(1, "a"), (1, "a"), (2, None)]))
    assert len(few) == 3 and max(Counter(r["shard"] for r in few).values()) == 1
    docs = [(i, f"p{i // 2}") for i in range(960)]  # no single row makes room
    rows = placed(spark, tables(documents=docs))
    assert set(Counter(r["shard"] for r in rows).values()) == {40}
    where = {}
    for r in rows:
        where.setdefault(r["doc_id"] // 2, set()).add(r["shard"])
    assert sum(len(s) == 1 for s in where.values()) > 0.8 * len(where)


@pytest.mark.parametrize("partitions", ["4", "12"])
def test_pairs_that_all_fit_are_not_cut(spark, tables, partitions):
    folder = tables(documents=[(i, f"p{i // 2}") for i in range(960)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        where = {}
        for r in placed(spark, folder):
            where.setdefault(r["doc_id"] // 2, set()).add(r["shard"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(len(s) > 1 for s in where.values()) < 0.01 * len(where)


def test_swaps_keep_sizes():
    import random

    pick = random.Random(8)
    for _ in range(50):
        cut = {(a, b): pick.randrange(4) for a in range(8) for b in range(a + 1, 8) if pick.random() < 0.5}
        cut = {k: n for k, n in cut.items() if n}
        room = {s: pick.choice([0, 0, 1]) for s in range(8)}
        gain, closed = Counter(), sharding.swaps(cut, room)
        for (a, b), (up, down) in closed.items():
            assert up + down <= cut[a, b]
            gain.update({b: up - down, a: down - up})
        assert all(gain[s] <= room[s] for s in room)
        # What stays cut holds no circle, so it is less than the number of shards.
        assert sum(cut.values()) - sum(map(sum, closed.values())) < 8


def test_quotas_never_overfill():
    wanted = {(0, 1, 9): 5, (1, 0, 3): 2, (2, 1, 1): 4}
    granted = sharding.quotas(wanted, {0: 0, 1: 1, 2: 0})
    assert granted[1, 0, 3] == 2 and granted[0, 1, 9] + granted[2, 1, 1] == 3
    circle = sharding.quotas({(0, 1, 0): 3, (1, 2, 0): 4, (2, 0, 0): 2}, {0: 0, 1: 0, 2: 0})
    assert set(circle.values()) == {2}


def test_running_sums(spark):
    rows = spark.createDataFrame([(k, i, i) for k in ("a", None) for i in range(500)], "k string, i long, v long")
    out = running(rows, ["k"], ["i"], "v", "before").collect()
    for key in ("a", None):
        mine = sorted((r["before"], r["v"]) for r in out if r["k"] == key)
        assert all(b[0] == a[0] + a[1] for a, b in zip(mine, mine[1:])) and mine[0][0] == 0
    assert sorted(r["n"] for r in ranked(rows, [], ["k", "i"], "n").collect()) == list(range(1000))


# --- mixing ----------------------------------------------------------------------------------

def test_mixture_meets_its_weights(spark, tables):
    docs = [(i, "w " * 10, "en", "big") for i in range(900)] + [(1000 + i, "w " * 10, "en", "mid") for i in range(300)]
    docs += [(2000 + i, "w " * 10, "en", None) for i in range(150)] + [(3000, None, "en", "void"), (3001, "", "en", "void")]
    folder = tables(documents=docs)
    rows = [r.asDict() for r in jobs.QUERIES["op8_mixing"](spark, folder).collect()]
    assert {r["doc_id"] for r in rows} == {d[0] for d in docs}
    tokens, weight = Counter(), {}
    for r in rows:
        tokens[r["source"]] += r["tokens"]
        weight[r["source"]] = r["weight"]
    total = sum(tokens.values())
    assert all(abs(tokens[s] - weight[s] * total) <= 30 for s in tokens)
    assert max(Counter(r["doc_id"] for r in rows).values()) == 2 and abs(tokens[None] - 2 * 1500) <= 10
    again = mixing.mixed(spark.read.parquet(f"{folder}/documents.parquet"))
    assert Counter(r["doc_id"] for r in again.collect()) == Counter(r["doc_id"] for r in rows)
    assert len({(r["block"], r["slot"]) for r in rows}) == len(rows)
    assert jobs.QUERIES["op8_mixing"](spark, tables()).collect() == []


def test_exponent_meets_the_entropy(spark):
    import math

    sources = spark.createDataFrame([(t,) for t in (1000, 300, 50, 0)], "tokens long")
    for target in (0.8, 1.0, 1.09):
        power = mixing.exponent(sources, None, target)
        weights = [(t / 1350) ** power for t in (1000, 300, 50)]
        weights = [w / sum(weights) for w in weights]
        assert abs(-sum(w * math.log(w) for w in weights) - target) < 1e-6
    assert abs((1000 / 50) ** (1 - mixing.exponent(sources, 4.0, None)) - 4.0) < 1e-6


# --- the pipeline ----------------------------------------------------------------------------

def test_pipeline(spark, tables):
    docs = [(i, f"This is a plain sentence number {i} about topic {i * 7} and nothing else at all.", "en", f"s{i % 3}") for i in range(60)]
    docs += [(100, docs[3][1], "en", "s0"), (101, "you idiot, moron, stupid worthless trash", "en", "s0"), (102, ITEM, "en", "s1"),
             (103, None, "en", None), (104, "", "en", "s2"), (105, "SALE!! NOW!! " * 30, "en", "s2")]
    folder = tables(documents=docs, benchmark=[(1, ITEM)], labels=[(1, 1, 0)])
    rows = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    kept = {r["doc_id"] for r in rows}
    assert not kept & {100, 101, 102, 104, 105} and set(range(60)) - kept == set() and 103 in kept
    assert "shard" in rows[0] and "lang" in rows[0]
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min([sizes.get(s, 0) for s in range(24)]) <= 1
    assert corpus_pipeline.run(spark, tables()).collect() == []


def test_stages_keep_columns(spark, tables):
    folder = tables(documents=[(1, "some text here", "en", "a")], labels=[(1, 1, 0)], benchmark=[(1, ITEM)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert decontaminate.LEAST == 0.8


def test_stages_take_columns_of_any_name_and_kind(spark, tables):
    folder = tables(labels=[(1, 1, 0)], benchmark=[(1, ITEM)])
    docs = spark.createDataFrame(
        [(i, f"some text number {i % 7} of {i}", "a", {"k": str(i)}, 1.5, "x") for i in range(40)],
        "doc_id long, text string, source string, `a map` map<string,string>, `a.b` double, `c``d` string",
    )
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        assert out.columns[:6] == docs.columns and rows, name
        assert all(r["a map"] == {"k": str(r["doc_id"])} and r["a.b"] == 1.5 and r["c`d"] == "x" for r in rows), name


@pytest.mark.parametrize("name", ["op4_sharding", "op8_mixing"])
def test_results_do_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("2", "12"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, jobs.QUERIES[name](spark, SF_DIR).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and found[0]
