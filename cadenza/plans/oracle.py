"""SQL preludes that the signal queries' oracles share."""

SIG = """
sig AS (SELECT event_type AS rec, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n,
               CAST(value AS DOUBLE) / 1024.0 AS v, event_id FROM events),
s AS (SELECT rec, n, v * (CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END)
             * (CASE WHEN CAST(floor(n / 60.0) AS BIGINT) % 4 = 3 THEN 0.001 ELSE 1.0 END) AS x FROM sig),
len AS (SELECT rec, max(n) + 1 AS length FROM s GROUP BY rec)"""

#: Block loudness by direct sums: blocks of 40 samples, one every 10.
BLK = SIG + """,
blk AS (SELECT b.rec, b.n // 10 AS b, sum(a.x * a.x) / 40.0 AS z FROM s b JOIN s a ON a.rec = b.rec AND a.n >= b.n AND a.n < b.n + 40
        JOIN len ON len.rec = b.rec WHERE b.n % 10 = 0 AND b.n + 40 <= length GROUP BY b.rec, b.n // 10),
lu AS (SELECT rec, b, z, CASE WHEN z > 0 THEN -0.691 + 10 * log10(z) END AS l FROM blk)"""

#: Silent runs of frames of 3 samples under -60 dB, at least 12 frames; and the segments between their middles.
SIL = SIG + """,
fr AS (SELECT rec, n // 3 AS f, avg(x * x) AS z FROM s GROUP BY rec, n // 3),
q AS (SELECT rec, f, f - row_number() OVER (PARTITION BY rec ORDER BY f) AS g FROM fr WHERE z < 1e-6),
sil AS (SELECT q.rec, row_number() OVER (PARTITION BY q.rec ORDER BY min(f)) - 1 AS i, min(f) * 3 AS start,
               least(max(length), (max(f) + 1) * 3) AS "end",
               CAST(floor((min(f) * 3 + least(max(length), (max(f) + 1) * 3)) / 2.0) AS BIGINT) AS mid
        FROM q JOIN len ON len.rec = q.rec GROUP BY q.rec, g HAVING count(*) >= 12),
cuts AS (SELECT rec, mid AS p FROM sil UNION SELECT rec, 0 FROM len UNION SELECT rec, length FROM len),
seg AS (SELECT * FROM (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY p) - 1 AS i, p AS start,
                              lead(p) OVER (PARTITION BY rec ORDER BY p) AS "end" FROM cuts) WHERE "end" IS NOT NULL),
segz AS (SELECT seg.rec, i, start, "end", avg(x * x) AS z FROM seg JOIN s ON s.rec = seg.rec AND n >= start AND n < "end"
         GROUP BY seg.rec, i, start, "end")"""

#: Segment gains towards -18 LUFS, at most 30 dB; speech is louder than -40 LUFS.
GAIN = SIL + """,
lev AS (SELECT *, CASE WHEN z > 0 THEN -0.691 + 10 * log10(z) END AS lufs FROM segz),
spk AS (SELECT *, coalesce(lufs > -40, false) AS is_speech FROM lev),
own AS (SELECT *, CASE WHEN is_speech THEN greatest(-30.0, least(30.0, -18 - lufs)) END AS gain FROM spk),
near AS (SELECT a.rec, a.i, arg_min(b.gain, abs(b.i - a.i) * 1000000 + b.i) AS g FROM own a JOIN own b ON a.rec = b.rec AND b.gain IS NOT NULL
         GROUP BY a.rec, a.i),
filled AS (SELECT own.rec, own.i, start, "end", lufs, is_speech, coalesce(g, 0.0) AS filled FROM own LEFT JOIN near ON near.rec = own.rec AND near.i = own.i),
nxt AS (SELECT *, lead(filled) OVER (PARTITION BY rec ORDER BY i) AS h FROM filled),
pts AS (SELECT sil.rec, sil.start AS p, filled AS db FROM sil JOIN nxt ON sil.rec = nxt.rec AND sil.i = nxt.i WHERE h IS NOT NULL
        UNION SELECT sil.rec, sil."end", h FROM sil JOIN nxt ON sil.rec = nxt.rec AND sil.i = nxt.i WHERE h IS NOT NULL
        UNION SELECT rec, 0, filled FROM nxt WHERE i = 0
        UNION SELECT nxt.rec, length, filled FROM nxt JOIN len ON len.rec = nxt.rec WHERE h IS NULL)"""


def select(prelude: str, query: str) -> str:
    return f"WITH {prelude}\n{query}"
