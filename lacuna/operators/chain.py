"""Append-only chains: numbers, stored links, content, keys, tips, and the plausibility of their times.

A chain's rows are ``(chain_id, pos, seq, prev_hash, entry_hash, ...)``; pos is the
order in which they are stored. Links compare stored digests, so all rows are
checked in parallel, those of one long chain too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.scan import before, first_of

GENESIS = "0" * 64
# The window of plausible times, its end outside.
EARLIEST, LATEST = "2000-01-01 00:00:00", "2038-01-19 03:14:07"


def link_errors(log: DataFrame, first_seq: int = 1, genesis: str = GENESIS, segment: Column | None = None) -> DataFrame:
    """Rows with expected_seq, expected_prev, seq_gap and broken_link. A null number or digest is as wrong as any other."""
    out = before(log, "chain_id", "pos", previous={"_seq": F.col("seq"), "_hash": F.col("entry_hash")}, segment=segment)
    out = out.withColumns({"expected_seq": F.coalesce(F.col("_seq") + 1, F.lit(first_seq)), "expected_prev": F.coalesce("_hash", F.lit(genesis))}).drop("_seq", "_hash")
    return out.withColumns({"seq_gap": ~F.col("seq").eqNullSafe(F.col("expected_seq")), "broken_link": ~F.col("prev_hash").eqNullSafe(F.col("expected_prev"))})


def content_errors(log: DataFrame, *recomputed: Column) -> DataFrame:
    """Rows with tampered: the stored digest is none of the recomputed ones."""
    same = [F.col("entry_hash").eqNullSafe(r) for r in recomputed]
    good = same[0]
    for s in same[1:]:
        good = good | s
    return log.withColumn("tampered", ~good)


def key_errors(log: DataFrame, mac: Callable[[Column], Column]) -> DataFrame:
    """Rows with hmac_error: the keyed digest is missing or does not recompute."""
    return log.withColumn("hmac_error", F.when(F.coalesce(F.col("entry_hmac"), F.lit("")) == "", "missing").when(F.col("entry_hmac") != mac(F.col("entry_hash")), "mismatch"))


def summarize(checked: DataFrame) -> DataFrame:
    """Per chain: length, errors of each kind, the least number with any error (null if no such row has one), validity, and the tip. A chain is valid if no row has an error."""
    kinds = [k for k in ("seq_gap", "broken_link", "tampered") if k in checked.columns]
    bad = F.lit(False)
    for k in kinds:
        bad = bad | F.coalesce(F.col(k), F.lit(True))
    if "hmac_error" in checked.columns:
        bad = bad | F.col("hmac_error").isNotNull()
    counts = [F.count_if(F.coalesce(F.col(k), F.lit(True))).alias(f"n_{k}") for k in kinds] + ([F.count("hmac_error").alias("n_hmac_error")] if "hmac_error" in checked.columns else [])
    out = checked.groupBy("chain_id").agg(F.count("*").alias("length"), *counts, F.min(F.when(bad, F.col("seq"))).alias("first_invalid_seq"), F.max_by("entry_hash", "pos").alias("tip"), F.count_if(bad).alias("_bad"))
    return out.withColumn("valid", F.col("_bad") == 0).drop("_bad")


def tip_errors(summary: DataFrame, declared: DataFrame, mac: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chains against declared(chain_id, chain_tip[, chain_tip_hmac]); a chain without rows has the genesis tip."""
    both = declared.join(summary.select("chain_id", "tip"), "chain_id", "left")
    tip = F.coalesce("tip", F.lit(GENESIS))
    out = both.withColumn("tip_mismatch", F.when(F.col("chain_tip").isNotNull(), F.col("chain_tip") != tip))
    return out if mac is None else out.withColumn("tip_hmac_mismatch", F.col("chain_tip_hmac") != mac(tip))


def anomalies(log: DataFrame, signature: Column, ts: str = "ts", segment: Column | None = None) -> DataFrame:
    """Rows with out_of_range, non_monotonic (against the last time that there is) and duplicate_of (number of the first with the same content)."""
    col = F.col(ts)
    kind = dict(log.dtypes)[ts]
    inside = (col >= F.lit(EARLIEST).cast(kind)) & (col < F.lit(LATEST).cast(kind))
    out = before(log.withColumn("_signature", signature), "chain_id", "pos", known={"_last": col}, segment=segment)
    out = out.withColumns({"out_of_range": F.coalesce(~inside, F.lit(False)), "non_monotonic": F.coalesce(col < F.col("_last"), F.lit(False))})
    return first_of(out, ["chain_id", "_signature"], "pos", F.col("seq"), "duplicate_of").drop("_signature", "_last")


def legacy_errors(log: DataFrame, segment: Column | None = None) -> DataFrame:
    """First-version chains: each entry stores the digest of the entry before's summary; the first has GENESIS."""
    out = before(log, "chain_id", "pos", previous={"_summary": F.col("result_summary")}, segment=segment)
    expected = F.when(F.col("seq") == 1, "GENESIS").otherwise(F.sha2(F.encode("_summary", "utf-8"), 256))
    return out.withColumn("expected_prev", expected).withColumn("broken_link", ~F.col("prev_hash").eqNullSafe(F.col("expected_prev"))).drop("_summary")


def versions(log: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Per chain its version: 2 if any entry has a mark of it (its version, a digest or a keyed digest), or a tip is declared; else 1.

    One mark anywhere is enough, so that taking it from the first entry
    doesn't have a chain checked by the weaker rules.
    """
    marks = [F.col(c).isNotNull() for c in ("entry_hash", "entry_hmac") if c in log.columns]
    if "chain_version" in log.columns:
        marks.append(F.coalesce(F.col("chain_version").cast("string") == "2", F.lit(False)))
    marked = F.lit(False)
    for m in marks:
        marked = marked | m
    out = log.groupBy("chain_id").agg(F.max(marked).alias("marked"))
    if declared is not None:
        tips = [F.col(c).isNotNull() for c in ("chain_tip", "chain_tip_hmac") if c in declared.columns]
        has_tip = tips[0]
        for t in tips[1:]:
            has_tip = has_tip | t
        out = out.join(declared.select("chain_id", has_tip.alias("has_tip")), "chain_id", "full").withColumn("marked", F.coalesce("marked", F.lit(False)) | F.coalesce("has_tip", F.lit(False)))
    return out.select("chain_id", F.when(F.col("marked"), 2).otherwise(1).alias("version"))


def append(events: DataFrame, digest: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """A chain of each group's events(chain_id, pos, payload): seq, prev_hash, entry_hash.

    The digest is by default that of the entry's canonical form: events stream
    in sorted order through one digest after the other, and no chain is held
    whole. With a function of columns (seq, prev_hash, payload) all stays in
    the JVM, as a fold over an array, for chains that fit in a row.
    """
    from lacuna.functions.canonical import entry_digest, strict_json

    if digest is not None:
        step = lambda acc, x: F.struct(digest(acc["seq"] + 1, acc["last"], x["payload"]).alias("last"), (acc["seq"] + 1).alias("seq"), F.array_append(acc["out"], F.struct(x["pos"].alias("pos"), x["payload"].alias("payload"), (acc["seq"] + 1).alias("seq"), acc["last"].alias("prev_hash"), digest(acc["seq"] + 1, acc["last"], x["payload"]).alias("entry_hash"))).alias("out"))
        rows = events.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("own"))
        empty = F.array().cast(f"array<struct<pos:{dict(events.dtypes)['pos']},payload:string,seq:int,prev_hash:string,entry_hash:string>>")
        start = F.struct(F.lit(GENESIS).alias("last"), F.lit(0).alias("seq"), empty.alias("out"))
        return rows.select("chain_id", F.explode(F.aggregate("own", start, step, lambda acc: acc["out"])).alias("e")).select("chain_id", "e.*")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, seq = None, GENESIS, 0
        for frame in frames:
            prev, own, numbers = [], [], []
            for key, payload in zip(frame["chain_id"], frame["payload"], strict=True):
                if not seq or key != at:
                    at, last, seq = key, GENESIS, 0
                seq += 1
                numbers.append(seq)
                prev.append(last)
                last = entry_digest(seq, last, strict_json(payload))
                own.append(last)
            yield frame.assign(seq=numbers, prev_hash=prev, entry_hash=own)

    types = dict(events.dtypes)
    ordered = events.select("chain_id", "pos", "payload").repartition("chain_id").sortWithinPartitions("chain_id", "pos")
    return ordered.mapInPandas(fold, f"chain_id {types['chain_id']}, pos {types['pos']}, payload string, seq int, prev_hash string, entry_hash string")
