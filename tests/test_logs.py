"""Logs verified by content, long chains by segments, and canonical forms in the plan."""

import hashlib
import json
import random
import struct
import unicodedata

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna import cli
from lacuna.functions import canonical, compiled
from lacuna.operators import chain, logs
from lacuna.operators.scan import before, first_of

KEY = b"k" * 32


def entries(n, key=None, version="2", **more):
    out, last = [], chain.GENESIS
    for seq in range(1, n + 1):
        said = {"event_id": f"e{seq}", "timestamp": f"2024-01-01T00:00:{seq:02}Z", "tool": "té", "arguments": {"n": seq, "x": [seq / 3, None, {"z": True}]}, "chain_version": "2", **more}
        own = canonical.entry_digest(seq, last, said, version)
        out.append({**said, "seq": seq, "prev_hash": last, "entry_hash": own, **({"entry_hmac": canonical.keyed(key, own)} if key else {})})
        last = own
    return out


@pytest.fixture
def run(spark, monkeypatch, tmp_path, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.delenv("LACUNA_HMAC_KEY", raising=False)

    def verify(logs_, *argv):
        """Exit code and, by file name, what is found of logs that are verified together."""
        folder = tmp_path / f"logs{random.random()}"
        folder.mkdir()
        for name, rows in logs_.items():
            (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
        capsys.readouterr()
        code = cli.main(["verify-log", str(folder), *map(str, argv)])
        found = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
        return code, {f["chain_id"].rsplit("/", 1)[-1]: f for f in found}

    return verify


def altered(n, k, **fields):
    rows = entries(n)
    rows[k].update(fields)
    return rows


def first_version():
    rows, said = [], None
    for seq in range(1, 4):
        rows.append({"seq": seq, "prev_hash": "GENESIS" if seq == 1 else hashlib.sha256(said.encode()).hexdigest(), "result_summary": (said := f"done {seq}")})
    return rows


def test_good_logs_are_valid(run):
    near = entries(2)
    near[1]["arguments"]["x"][0] += 1e-12  # less than eight decimals
    good = {"plain": entries(5), "old_form": entries(3, version="1"), "text": entries(3, tool="cafe\u0301\r\n"), "near": near, "numbers": entries(2, big=10**30, small=-(2**63), half=0.5, power=1e22), "digits": entries(2, digits="1" * 64), "first": first_version()}
    code, found = run(good)
    assert code == 0 and found.keys() == good.keys() and all(f["valid"] and f["n_tampered"] == 0 for f in found.values())
    assert found["plain"]["length"] == 5 and found["plain"]["plausible"] and found["first"]["version"] == 1 and found["plain"]["version"] == 2


def test_damage_shows(run):
    cut, foreign, downgraded, summary = entries(4), entries(2), entries(3), first_version()
    del cut[2]["entry_hash"], downgraded[0]["entry_hash"], foreign[1]["seq"]
    foreign[1]["prev_hash"] = "x"
    summary[1]["result_summary"] = "other"
    text = json.dumps(entries(1)[0])[:-1]
    fields = {"tool": "u", "extra": 1, "timestamp": None, "arguments": {"n": 2, "x": [2 / 3 + 1e-8, None, {"z": True}]}, "seq": "2", "entry_hash": "0" * 64}
    bad = {**{f"field_{k}": altered(3, 1, **{k: v}) for k, v in fields.items()}, "whole_float": altered(3, 1, seq=2.0), "cut": cut, "foreign": foreign, "downgraded": downgraded, "summary": summary}
    bad |= {"other": [{"x": 1}, {"x": 1}], "no_json": [*entries(2), "{"], "twice": [text + ', "tool": "t\u00e9"}'], "deep": [text + f', "deep": {"[" * 100}{"]" * 100}}}'], "long": entries(2, big=10**40), "gap": entries(4)[:1] + entries(4)[2:]}
    code, found = run(bad)
    assert code == 1 and found.keys() == bad.keys() and [k for k, f in found.items() if f["valid"]] == []
    assert all(found[f"field_{k}"]["n_tampered"] == 1 for k in fields)
    assert found["foreign"]["n_broken_link"] == 1 and found["foreign"]["n_seq_gap"] == 1 and found["other"]["version"] == 1
    assert found["no_json"]["n_unreadable"] == 1 and found["long"]["n_unreadable"] == 2 and found["deep"]["n_tampered"] == 1
    assert found["gap"]["n_seq_gap"] == found["gap"]["n_broken_link"] == 1 and found["gap"]["first_invalid_seq"] == 3


def test_nothing_to_verify_is_refused(run):
    assert run({"empty": []})[0] == 2


def test_keys_and_tips(run, monkeypatch, tmp_path):
    rows = entries(3, KEY)
    tip = rows[-1]["entry_hash"]
    monkeypatch.setenv("LACUNA_HMAC_KEY", KEY.hex())
    line = lambda c, k: {"chain_id": c, "pos": k, **{n: rows[k][n] for n in logs.STRUCTURE}, "payload": json.dumps({a: b for a, b in rows[k].items() if a not in logs.STRUCTURE})}
    lines = [line("whole", k) for k in range(3)] + [line("short", k) for k in range(2)] + [line("forged", k) for k in range(3)]
    unsigned = [*rows[:2], {k: v for k, v in rows[2].items() if k != "entry_hmac"}]
    declared = [("whole", canonical.keyed(KEY, tip)), ("short", canonical.keyed(KEY, tip)), ("forged", "0"), ("gone", None)]
    tips = tmp_path / "tips"
    tips.write_text("".join(json.dumps({"chain_id": c, "chain_tip": tip, "chain_tip_hmac": m}) + "\n" for c, m in declared))
    code, found = run({"lines": lines, "signed": rows, "unsigned": unsigned}, "--tips", tips)
    assert code == 1 and {c for c, f in found.items() if f["valid"]} == {"whole", "signed"}
    assert found["unsigned"]["n_hmac_error"] == 1 and found["short"]["tip_mismatch"] and found["short"]["n_tampered"] == 0
    assert not found["forged"]["tip_mismatch"] and found["forged"]["tip_hmac_mismatch"] and found["gone"]["length"] == 0


def test_logs_of_bundles(run):
    rows = entries(3)
    good = {"tool_execution_log": rows, "chain_tip_sha256": rows[-1]["entry_hash"]}
    code, found = run({"good": [good], "short": [{**good, "tool_execution_log": rows[:2]}], "no_tip": [{"tool_execution_log": rows[:2]}]}, "--bundle")
    assert code == 1 and {c for c, f in found.items() if f["valid"]} == {"good", "no_tip"} and found["short"]["tip_mismatch"]


def test_times_and_repeated_content(spark):
    rows = entries(4)
    for k, when in enumerate(("2024-01-01T00:00:09+00:00", "1999-01-01T00:00:00Z", "no time", "2024-01-01 00:00:05")):
        rows[k]["timestamp"] = when
        rows[k]["arguments"] = {"n": k // 2}
    log = spark.createDataFrame([("c", (k, 0, 0), 0, json.dumps(r)) for k, r in enumerate(rows)], "chain_id string, pos struct<given:bigint,block:bigint,row:bigint>, segment long, text string")
    log = log.select("chain_id", "pos", "segment", F.parse_json("text").alias("line"), F.parse_json("text").alias("entry"), F.lit(3).alias("depth"))
    got = [tuple(r) for r in logs.check_entries(log).orderBy("pos").select("out_of_range", "non_monotonic", "duplicate_of").collect()]
    assert got == [(False, False, None), (True, True, 1), (False, False, None), (False, False, 3)]


@pytest.mark.parametrize("segment", [3, 50, 10**6])
def test_segments_equal_one_window(spark, segment):
    rng = random.Random(segment)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), k, rng.choice([None, k]), rng.choice([None, None, rng.randrange(50)]), rng.choice("xyz")) for k in range(400)]
    df = spark.createDataFrame(rows, "chain_id string, pos long, seq long, t long, s string")
    w = Window.partitionBy("chain_id").orderBy("pos")
    want = df.withColumns({"p": F.lag("seq").over(w), "l": F.last("t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "d": F.when(F.row_number().over(Window.partitionBy("chain_id", "s").orderBy("pos")) > 1, F.first("pos").over(Window.partitionBy("chain_id", "s").orderBy("pos")))})
    got = first_of(before(df, "chain_id", "pos", previous={"p": F.col("seq")}, known={"l": F.col("t")}, segment=F.floor(F.col("pos") / segment)), ["chain_id", "s"], "pos", F.col("pos"), "d")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_long_chain_is_many_tasks_work(spark):
    log = spark.range(40_000).select(F.lit(1).alias("chain_id"), F.col("id").alias("pos"), (F.col("id") + 1).alias("seq"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("entry_hash"), F.when(F.col("id") > 0, F.sha2((F.col("id") - 1).cast("string").cast("binary"), 256)).otherwise(chain.GENESIS).alias("prev_hash"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        checked = chain.link_errors(log, segment=F.floor(F.col("pos") / 1000)).withColumn("part", F.spark_partition_id())
        assert checked.groupBy("part").count().count() == 4 and chain.summarize(checked).first()["valid"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_floats_equal_pythons(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5e-9, 1.5e-8, 2.5e-8, 0.5, 1e-300, 1e300, 1e23, 2.0**53, 2.0**63, 2.0**63 - 1024, 0.999999995, 0.99999999499999995, -1e-10, float("nan"), float("inf"), -float("inf"), 5e-324, 1.7976931348623157e308]
    values += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(500)] + [rng.random() * 10 ** rng.randrange(-10, 18) for _ in range(500)] + [rng.randrange(10**9) / 2 ** rng.randrange(40) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").coalesce(1).select(compiled.float8(F.col("v")))
    assert [r[0] for r in df.collect()] == [*map(canonical.float8, values), None]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_texts_equal_pythons(spark):
    rng = random.Random(2)
    pool = [*map(chr, range(0x300, 0x330)), *"aeou=<>AEO\n\"\\\r", "ᄀ", "ᅡ", "ᆨ", "가", "̈́", "Å", "क़", "़", "क", "ẛ", "\U0001d157", "\U0001d165", "̧", "ְ", "゙", "か", "ཱ", "ི", "\x00", "\x7f", "\U0001f600"]
    texts = ["", *("".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(800))]
    df = spark.createDataFrame([(t,) for t in texts], "v string").coalesce(1)
    got = df.select(compiled.canonical_json(F.col("v"), T.StringType()), compiled.nfc(F.col("v"))).collect()
    assert [r[0] for r in got] == [json.dumps(canonical.canonical(t)) for t in texts]
    assert [r[1] for r in got] == [unicodedata.normalize("NFC", t) for t in texts]


def test_nested_values_equal_pythons(spark):
    docs = ['{"b":[1,2.5,{"z":null,"a":[]}],"a":{"é":"x","q\\"":true},"n":12345678901234567890,"f":1e400}', "[]", "{}", "null", "5", "-0", '"x"', "[[[[1]]]]", "1.0", "-0.0", "1e5", '{"a":{}}', '{"b":1,"a":{"c":"\\u0065\\u0301"}}']
    df = spark.createDataFrame([(d,) for d in docs], "v string").coalesce(1)
    for version in ("1", "2"):
        got = [r[0] for r in df.select(compiled.variant_json(F.parse_json("v"), 5, version)).collect()]
        assert got == [json.dumps(canonical.canonical(json.loads(d), version), sort_keys=True) for d in docs]
    assert [r[0] is None for r in df.select(compiled.variant_json(F.parse_json("v"), 3)).collect()] == [d == docs[0] or d == "[[[[1]]]]" for d in docs]
    assert [r[0] for r in df.select(compiled.nesting(F.col("v"))).collect()][:8] == [4, 1, 1, 0, 0, 0, 0, 4]
    kind = T.StructType().add("b", T.ArrayType(T.DoubleType())).add("a", T.StructType().add("x", T.LongType()).add("m", T.MapType(T.StringType(), T.BooleanType())))
    rows = spark.createDataFrame([([1.5, None], (3, {"z": True, "a": None})), (None, None), ([], (None, {}))], kind)
    got = [r[0] for r in rows.select(compiled.canonical_json(F.struct("*"), kind)).collect()]
    assert got == [json.dumps(canonical.canonical(r.asDict(True)), sort_keys=True) for r in rows.collect()]
    with pytest.raises(TypeError):
        compiled.canonical_json(F.col("x"), T.BinaryType())


def test_texts_that_need_no_normal_form_are_cheap(spark):
    import time
    import unicodedata

    from lacuna.functions import compiled

    # No character below U+0300 is one that normal form C changes or joins; nor is one of the plain stretches.
    risky = "".join(map(chr, range(0x300))) + "語한Жяא"
    assert unicodedata.is_normalized("NFC", risky)
    texts = ["Grüße, ça va " * 500_000, "Привет, мир " * 500_000, "é" * 50 + "ȩ́" + "Ж"]
    df = spark.createDataFrame([(t,) for t in texts], "v string").cache()
    df.count()
    began = time.perf_counter()
    got = [r[0] for r in df.select(compiled.nfc(F.col("v"))).collect()]
    assert time.perf_counter() - began < 15
    assert got == [unicodedata.normalize("NFC", t) for t in texts]


def test_long_texts_in_entries_are_cheap(spark):
    import time

    texts = ["Grüße, ça va " * 400_000, "naïve façade " * 400_000]
    lines = [json.dumps({"seq": k, "prev_hash": "0" * 64, "text": t, "entry_hash": canonical.entry_digest(k, "0" * 64, {"text": t})}) for k, t in enumerate(texts, 1)]
    df = spark.createDataFrame([("c", k, line) for k, line in enumerate(lines)], "chain_id string, at long, line string").cache()
    df.count()
    place = F.struct(F.col("at").alias("given"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"))
    log = df.select("chain_id", place.alias("pos"), F.lit(0).cast("long").alias("segment"), F.try_parse_json("line").alias("line"), logs.parsed(F.col("line")).alias("entry"), F.lit(1).alias("depth"))
    began = time.perf_counter()
    got = [r["tampered"] for r in logs.check_entries(log, depth=1).collect()]
    assert time.perf_counter() - began < 40
    assert got == [False, False]


def test_a_texts_line_ends_are_changed_once_and_its_depth_is_given(spark):
    from lacuna import queries

    df = spark.createDataFrame([("a\r\né\ré\n\"",)], "v string")
    made = df.select(compiled._string(F.col("v"), "2"))
    assert made._jdf.queryExecution().analyzed().toString().count("regexp_replace(v#") == 1
    assert made.first()[0] == json.dumps("s:" + unicodedata.normalize("NFC", "a\né\né\n\""))
    assert queries.content_log(spark, "/root/testdata/sf0.001").agg(F.max("depth")).first()[0] == queries.CONTENT_DEPTH
