"""Queries over sessions of any length: the results of windows, by chunks; and frames in long streams of bytes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempofuse.functions.codec import FrameFormat, decode_frame, encode_frame
from tempofuse.operators import scans
from tempofuse.plans import alignment  # noqa: F401
from tempofuse.plans.base import SAMPLES, SQL, query
from tempofuse.sources import bytestreams
from tempofuse.sources.tables import samples
from tempofuse.streaming import flows, live

#: Rows of a chunk and bytes of a block here: small, so that sessions of the given tables take several.
ROWS, BLOCK = 2_000, 1_024


@query(SQL["running_total"])
def long_total(spark, d):
    return scans.running(samples(spark, d), "v", "total", rows=ROWS).select("session", "seq", F.round("total", 2).alias("total"))


@query(f"WITH {SAMPLES} SELECT session, seq, max(v) OVER (PARTITION BY session ORDER BY t, seq) AS most FROM s")
def long_peak(spark, d):
    return scans.running(samples(spark, d), "v", "most", F.max, rows=ROWS).select("session", "seq", "most")


@query(SQL["clock_unwrap"])
def long_clock(spark, d):
    s = samples(spark, d).withColumn("tx", (F.col("t_us") * 7) % F.lit(1 << 32))
    return scans.unwrapped(s, "tx", rows=ROWS).select("session", "seq", "unwrapped")


@query(SQL["fill_nulls"])
def long_fill(spark, d):
    s = samples(spark, d).withColumn("v", F.when(F.col("marker") != "error", F.col("v")))
    return scans.fill_missing(s, rows=ROWS).select("session", "seq", F.round("filled", 5).alias("filled"))


@query(SQL["asof_prev_next"])
def long_asof(spark, d):
    left, right = alignment._two(spark, d)
    return scans.asof(left.drop("v"), right, rows=ROWS).select("session", "seq", F.round("prev_t", 6).alias("prev_t"), "prev_v", F.round("next_t", 6).alias("next_t"), "next_v")


# A session's rows as checked frames: device clocks of 2.5 ms that start over after three; every 13th by seq is a late one
# of three rows before, every 11th has a wrong sum, every 7th has three other bytes before it, every 5th is sent twice.
_CLOCK = 4294960000


def _sent(rows):
    """rows (session, seq, k) with data, the bytes that the device sends."""
    place = F.col("k") - F.when(F.col("seq") % 13 == 0, 3).otherwise(0)
    tick = F.pmod(_CLOCK + place * 2500, F.lit(1 << 32))
    body = F.unhex(F.concat(F.lpad(F.hex(tick), 8, "0"), F.rpad(F.hex("seq"), 68, "0")))
    crc = (bytestreams.crc16_batches(body) + F.when(F.col("seq") % 11 == 0, 1).otherwise(0)) % 65536
    frame = F.concat(F.lit("A55A"), F.hex(body), F.lpad(F.hex(crc.cast("long")), 4, "0"))
    text = F.concat(F.when(F.col("seq") % 7 == 0, "0102A5").otherwise(""), F.repeat(frame, F.when(F.col("seq") % 5 == 0, 2).otherwise(1)))
    return rows.select("session", "seq", F.unhex(text).alias("data"))


_TABLE = "t0(b, c, k) AS (SELECT b, (b << 8)::INT, 0 FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, CASE WHEN c & 32768 <> 0 THEN xor((c << 1) & 65535, 4129) ELSE (c << 1) & 65535 END, k + 1 FROM t0 WHERE k < 8), crc AS (SELECT b, c FROM t0 WHERE k = 8)"
_SENT_SQL = f"""WITH RECURSIVE {SAMPLES}, {_TABLE}, k AS (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS k FROM s),
 p AS (SELECT *, k - CASE WHEN seq % 13 = 0 THEN 3 ELSE 0 END AS place FROM k), h AS (SELECT *, ({_CLOCK} + place * 2500) % 4294967296 AS tick, lpad(hex((({_CLOCK} + place * 2500) % 4294967296)::BIGINT), 8, '0') || rpad(hex(seq), 68, '0') AS h FROM p),
 r(session, seq, h, c, i) AS (SELECT session, seq, h, 65535, 0 FROM h WHERE seq % 11 <> 0 UNION ALL SELECT r.session, r.seq, r.h, xor((r.c << 8) & 65535, crc.c), r.i + 1 FROM r JOIN crc ON crc.b = xor(r.c >> 8, ('0x' || substr(r.h, 2 * r.i + 1, 2))::INT) WHERE r.i < 38),
 w AS (SELECT *, sum(CASE WHEN seq % 7 = 0 THEN 3 ELSE 0 END + CASE WHEN seq % 11 = 0 THEN CASE WHEN seq % 5 = 0 THEN 84 ELSE 42 END ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS lost FROM h),
 g AS (SELECT *, lost - coalesce(lag(lost) OVER x, 0) AS skipped, max(place) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, sum(CASE WHEN seq % 5 = 0 THEN 2 ELSE 1 END) OVER x - CASE WHEN seq % 5 = 0 THEN 2 ELSE 1 END AS number FROM w WHERE seq % 11 <> 0 WINDOW x AS (PARTITION BY session ORDER BY seq))
 SELECT g.session, number::BIGINT AS number, tick::BIGINT AS tick, c::INT AS crc, skipped::BIGINT AS skipped FROM g JOIN r ON r.session = g.session AND r.seq = g.seq AND r.i = 38 WHERE best IS NULL OR place > best"""


def _tick(payload):
    return F.conv(F.hex(F.substring(payload, 1, 4)), 16, 10).cast("long")


@query(_SENT_SQL)
def checked_stream(spark, d):
    """Checked frames of each session's bytes, found by blocks; repeated and late ones dropped; their sums as sent."""
    rows = scans.running(samples(spark, d).select("session", "seq", F.lit(1).alias("one")), "one", "k", order=("seq",), rows=ROWS).withColumn("k", F.col("k") - 1)
    found = bytestreams.find_frames(_sent(rows), bytestreams.CheckedFrames(), block=BLOCK, rows=ROWS)
    tick = F.conv(F.hex(F.substring("frame", 3, 4)), 16, 10).cast("long")
    kept = bytestreams.newer_frames(found, tick, rows=ROWS)
    return kept.select("session", "number", tick.alias("tick"), F.conv(F.hex(F.substring("frame", 41, 2)), 16, 10).cast("int").alias("crc"), "skipped")


@query(_SENT_SQL)
def stream_checked_frames(spark, d):
    """The same, as they come; sums made again from the payloads."""
    rows = samples(spark, d).select("session", "seq", (F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1).alias("k"))
    found = flows.drained(live.parsed_checked_frames(flows.as_stream(_sent(rows))))
    return found.select("session", "number", _tick("payload").alias("tick"), bytestreams.crc16_batches(F.col("payload")).alias("crc"), "skipped")


# What the reader takes: e are the places of the sync word, which a clock may hold by chance too; c the places where a frame
# can begin, as the word ends it and the next frame, if all of it is there; r goes from each to the first one after its end.
_PLAIN_SQL = f"""WITH RECURSIVE {SAMPLES}, k AS (SELECT session, seq, lpad(hex((t_us % 4294967296)::BIGINT), 8, '0') || repeat('0', 48) || '0FFF' || CASE WHEN seq % 9 = 0 THEN '0102030405' ELSE '' END AS h FROM s),
 b AS (SELECT *, 3 + sum(length(h) // 2) OVER (PARTITION BY session ORDER BY seq)::BIGINT - length(h) // 2 AS p FROM k), a AS (SELECT session, '0102FF' || string_agg(h, '' ORDER BY seq) AS h, 3 + sum(length(h) // 2)::BIGINT AS n FROM k GROUP BY session),
 w AS (SELECT session, p + j AS e FROM b, (SELECT unnest([0, 1, 2, 28]) AS j) WHERE substr(h, (2 * j + 1)::BIGINT, 4) = '0FFF'),
 c AS (SELECT w.session, w.e - 28 AS p FROM w JOIN a USING (session) LEFT JOIN w x ON x.session = w.session AND x.e = w.e + 30 WHERE w.e >= 28 AND (x.e IS NOT NULL OR w.e + 32 > a.n)),
 d AS (SELECT c.session, c.p, n.p AS after FROM c ASOF LEFT JOIN c n ON n.session = c.session AND n.p >= c.p + 30),
 r(session, number, p, after, skipped) AS (SELECT session, 0::BIGINT, min(p), arg_min(after, p), min(p) FROM d GROUP BY session UNION ALL SELECT d.session, r.number + 1, d.p, d.after, d.p - r.p - 30 FROM r JOIN d ON d.session = r.session AND d.p = r.after)
 SELECT r.session, number, ('0x' || substr(a.h, 2 * r.p + 1, 8))::BIGINT AS tx_us, skipped::BIGINT AS skipped FROM r JOIN a USING (session)"""


@query(_PLAIN_SQL)
def long_frames(spark, d):
    """Plain frames of each session's bytes, found by blocks; other bytes stand at the start and after every ninth by seq,
    which the frame after it does not vouch for then."""
    layout = FrameFormat()
    zero = {n: F.lit(0.0) for n in layout.signed} | {n: F.lit(0) for n in layout.unsigned[:-1]}
    s = samples(spark, d)
    sent = s.select("session", "seq", F.concat(encode_frame(F.col("t_us"), zero, layout), F.when(F.col("seq") % 9 == 0, F.unhex(F.lit("0102030405"))).otherwise(F.unhex(F.lit("")))).alias("data"))
    lead = s.select("session").distinct().select("session", F.lit(-1).cast("long").alias("seq"), F.unhex(F.lit("0102FF")).alias("data"))
    found = bytestreams.find_frames(sent.unionByName(lead), bytestreams.SyncFrames(), block=BLOCK, rows=ROWS)
    return found.select("session", "number", decode_frame(F.col("frame"), layout)["tx_us"].alias("tx_us"), "skipped")
