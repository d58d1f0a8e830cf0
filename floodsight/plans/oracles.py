"""The registered queries as plain SQL for DuckDB, written apart from the Spark code.

Alarms come from a recursive walk over all ticks, not from the closed form.
"""

EPOCH = 1704067200

PACKETS = """
packets AS (
SELECT pkt_id, 'ring' || CAST(uid % 12 AS VARCHAR) AS source_id,
  base + CAST(FLOOR(r / k) AS BIGINT) AS tick, proto,
  CASE WHEN pkt_id % 97 = 0 THEN 0 ELSE 3325256704 + uid % 256 END AS src_ip,
  3405803776 + uid % 16 AS dst_ip,
  CASE WHEN proto = 1 THEN NULL ELSE 1024 + (uid * 37) % 50000 END AS sport,
  CASE WHEN proto = 1 THEN NULL WHEN pkt_id % 5 = 0 THEN 80 WHEN pkt_id % 5 = 1 THEN 443
       WHEN pkt_id % 5 = 2 THEN 53 WHEN pkt_id % 5 = 3 THEN 22 ELSE 0 END AS dport,
  CASE WHEN proto = 6 THEN (pkt_id * 7919) % 4294967296 END AS seq,
  CASE WHEN proto = 6 THEN (pkt_id % 3) * 1000003 END AS ack,
  CASE WHEN proto = 6 THEN (pkt_id % 4) * 4096 END AS win,
  CASE WHEN proto = 6 THEN 20 + (pkt_id % 3) * 4 END AS tcp_hlen,
  CASE WHEN event_type = 'click' THEN 16 WHEN event_type = 'purchase' THEN 6
       WHEN event_type = 'signup' THEN 34 END AS tcp_flags,
  CASE WHEN proto = 17 THEN 8 + CAST(FLOOR(value) AS BIGINT) END AS udp_len,
  CASE WHEN proto = 1 THEN (CASE WHEN pkt_id % 2 = 0 THEN 8 ELSE 0 END) END AS icmp_type,
  CASE WHEN proto = 1 THEN pkt_id % 3 END AS icmp_code,
  60 + CAST(FLOOR(value) AS BIGINT) AS frame_len
FROM (
  SELECT event_id AS pkt_id, user_id AS uid, event_type, value, event_id % 1000 AS r,
    CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 17 ELSE 6 END AS proto,
    CAST(FLOOR(event_id / 2000) AS BIGINT) * 120
      + CASE WHEN event_id % 2000 >= 1000 THEN 100 ELSE 0 END AS base,
    CASE WHEN event_id % 2000 >= 1000 THEN 50 ELSE 10 END AS k
  FROM events) e)"""

RULES = """
rules(rule_type, list_rank, rule_no, proto, src_lo, src_hi, dst_lo, dst_hi, dport_lo, dport_hi, flag_bits, flag_mask,
      len_above, type_is, type_below, code_is, pps_th, bps_th, pps_period, bps_period, next_rule, comment, text_rule) AS (
VALUES
 ('tcp', 1, 0, 6, NULL, NULL, 3405803776, 3405803791, 80, 443, NULL, NULL, NULL, NULL, NULL, NULL, 10, 0, 3, 10, TRUE, '',
  '-d 203.0.113.0/28 --dport 80-443 --pps-th 10p --pps-th-period 3 --next '),
 ('tcp', 1, 1, 6, NULL, NULL, 3405803781, 3405803781, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 500, 10, 1, FALSE, '',
  '-d 203.0.113.5/32 --bps-th 4Kb --bps-th-period 1 '),
 ('tcp', 1, 2, 6, 3325256704, 3325256831, NULL, NULL, NULL, NULL, 16, 18, NULL, NULL, NULL, NULL, 10, 0, 5, 10, FALSE, 'syn',
  '-s 198.51.100.0/25 --tcp-flag S:1,A:0 --pps-th 10p --pps-th-period 5 --comment syn '),
 ('tcp', 1, 3, 6, NULL, NULL, 0, 4294967295, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 10, 2000, 4, 6, FALSE, '',
  '-d 0.0.0.0/0 --pps-th 10p --pps-th-period 4 --bps-th 16Kb --bps-th-period 6 '),
 ('udp', 2, 0, 17, NULL, NULL, 3405803776, 3405804031, 53, 53, NULL, NULL, NULL, NULL, NULL, NULL, 2, 0, 1, 10, FALSE, '',
  '-d 203.0.113.0/24 --dport 53 --pps-th 2p --pps-th-period 1 '),
 ('udp', 2, 1, 17, NULL, NULL, 0, 4294967295, NULL, NULL, NULL, NULL, 100, NULL, NULL, NULL, 0, 125, 10, 1, FALSE, '',
  '-d 0.0.0.0/0 --hlen >100 --bps-th 1Kb --bps-th-period 1 '),
 ('icmp', 3, 0, 1, NULL, NULL, 3405803776, 3405804031, NULL, NULL, NULL, NULL, NULL, 8, NULL, 0, 1, 0, 1, 10, TRUE, '',
  '-d 203.0.113.0/24 --type =8 --code =0 --pps-th 1p --pps-th-period 1 --next '),
 ('icmp', 3, 1, 1, NULL, NULL, 0, 4294967295, NULL, NULL, NULL, NULL, NULL, NULL, 5, NULL, 4, 0, 2, 10, FALSE, '',
  '-d 0.0.0.0/0 --type <5 --pps-th 4p --pps-th-period 2 '))"""

HITS = """
hits AS (
SELECT p.*, r.rule_type, r.rule_no, r.next_rule FROM packets p JOIN rules r ON p.proto = r.proto
 AND (r.src_lo IS NULL OR (p.src_ip <> 0 AND p.src_ip >= r.src_lo AND p.src_ip <= r.src_hi))
 AND (r.dst_lo IS NULL OR (p.dst_ip <> 0 AND p.dst_ip >= r.dst_lo AND p.dst_ip <= r.dst_hi))
 AND (r.dport_lo IS NULL OR (p.dport <> 0 AND p.dport >= r.dport_lo AND p.dport <= r.dport_hi))
 AND (r.flag_mask IS NULL OR (p.tcp_flags & r.flag_mask) = r.flag_bits)
 AND (r.len_above IS NULL OR p.udp_len > r.len_above)
 AND (r.type_is IS NULL OR p.icmp_type = r.type_is)
 AND (r.type_below IS NULL OR p.icmp_type < r.type_below)
 AND (r.code_is IS NULL OR p.icmp_code = r.code_is))"""

MATCHED = """
stops AS (SELECT pkt_id, min(rule_no) AS stop FROM hits WHERE NOT next_rule GROUP BY pkt_id),
matched AS (SELECT h.* FROM hits h LEFT JOIN stops s ON h.pkt_id = s.pkt_id WHERE s.stop IS NULL OR h.rule_no <= s.stop)"""

TICKS = """
ticks AS (SELECT rule_type, rule_no, tick, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes
  FROM matched GROUP BY rule_type, rule_no, tick),
dst_counts AS (SELECT rule_type, rule_no, tick, dst_ip, count(*) AS packets
  FROM matched GROUP BY rule_type, rule_no, tick, dst_ip),
top_dst AS (SELECT rule_type, rule_no, tick, dst_ip,
    concat_ws('.', dst_ip // 16777216, dst_ip // 65536 % 256, dst_ip // 256 % 256, dst_ip % 256) AS dst
  FROM (SELECT *, row_number() OVER (PARTITION BY rule_type, rule_no, tick ORDER BY packets DESC, dst_ip) AS n
        FROM dst_counts) WHERE n = 1)"""

GRID = """
grid AS (SELECT r.*, t.tick, coalesce(k.packets, 0) AS pps, coalesce(k.bytes, 0) AS bps
  FROM rules r CROSS JOIN (SELECT unnest(range(0, (SELECT max(tick) + 1 FROM packets))) AS tick) t
  LEFT JOIN ticks k ON k.rule_type = r.rule_type AND k.rule_no = r.rule_no AND k.tick = t.tick)"""

WALK = """
walk AS (
SELECT rule_type, rule_no, CAST(0 AS BIGINT) AS tick, CAST(-1000000 AS BIGINT) AS pps_good,
  CAST(-1000000 AS BIGINT) AS bps_good, CAST(NULL AS VARCHAR) AS fired FROM rules
UNION ALL
SELECT rule_type, rule_no, tick,
  CASE WHEN pps_th > 0 AND (pps <= pps_th OR pps_fires) THEN tick ELSE pps_good END,
  CASE WHEN bps_th > 0 AND NOT pps_fires AND (bps <= bps_th OR tick - bps_good > bps_period) THEN tick ELSE bps_good END,
  CASE WHEN pps_fires THEN 'pps'
       WHEN bps_th > 0 AND bps > bps_th AND tick - bps_good > bps_period THEN 'bps' END
FROM (SELECT g.*, w.pps_good, w.bps_good,
        g.pps_th > 0 AND g.pps > g.pps_th AND g.tick - w.pps_good > g.pps_period AS pps_fires
      FROM walk w JOIN grid g ON g.rule_type = w.rule_type AND g.rule_no = w.rule_no AND g.tick = w.tick + 1)),
alarms AS (SELECT w.rule_type, w.rule_no, w.tick, w.fired AS trigger, g.pps, g.bps, g.comment, g.proto, g.pps_th,
    g.bps_th, d.dst, d.dst_ip
  FROM walk w JOIN grid g ON g.rule_type = w.rule_type AND g.rule_no = w.rule_no AND g.tick = w.tick
  JOIN top_dst d ON d.rule_type = w.rule_type AND d.rule_no = w.rule_no AND d.tick = w.tick
  WHERE w.fired IS NOT NULL)"""

POINTS = """
points AS (
SELECT tick, rule_type AS measurement, rule_no AS rule, CAST(NULL AS VARCHAR) AS type, pps, bps * 8 AS bps
  FROM grid WHERE tick % 10 = 0
UNION ALL
SELECT tick, 'total', NULL, rule_type, CAST(sum(pps) AS BIGINT), CAST(sum(bps) * 8 AS BIGINT)
  FROM grid WHERE tick % 10 = 0 GROUP BY tick, rule_type)"""

_PARTS = {
    "packets": [PACKETS],
    "hits": [PACKETS, RULES, HITS],
    "matched": [PACKETS, RULES, HITS, MATCHED],
    "ticks": [PACKETS, RULES, HITS, MATCHED, TICKS],
    "grid": [PACKETS, RULES, HITS, MATCHED, TICKS, GRID],
    "points": [PACKETS, RULES, HITS, MATCHED, TICKS, GRID, POINTS],
    "alarms": [PACKETS, RULES, HITS, MATCHED, TICKS, GRID, WALK],
}


def _over(part: str, select: str, *more: str) -> str:
    return f"WITH RECURSIVE {','.join([*_PARTS[part], *more])}\n{select}"


_PACKET_COLUMNS = """pkt_id, source_id, proto, src_ip, dst_ip, frame_len, sport, dport, seq, ack, win, tcp_hlen,
  tcp_flags, udp_len, icmp_type, icmp_code, tick"""

_FIRST = "SELECT pkt_id, rule_type, rule_no FROM matched"

_CAPTURE = """
captured AS (SELECT a.rule_type, a.rule_no, a.tick AS alarm_tick, p.pkt_id, p.dst_ip, p.tick,
    row_number() OVER (PARTITION BY a.rule_type, a.rule_no, a.tick ORDER BY p.tick, p.pkt_id) AS position
  FROM alarms a JOIN packets p ON p.proto = a.proto AND p.dst_ip = a.dst_ip
   AND p.tick BETWEEN a.tick AND a.tick + 60)"""

_CAPTURE_COLUMNS = "rule_type, rule_no, alarm_tick, pkt_id, dst_ip, tick"

_PER_RULE = """
per_rule AS (SELECT rule_type, list_rank, rule_no, text_rule, CAST(sum(pps) AS BIGINT) AS packets,
    CAST(sum(bps) AS BIGINT) AS bytes,
    CAST(sum(CASE WHEN tick = (SELECT max(tick) FROM ticks) THEN pps ELSE 0 END) AS BIGINT) AS pps,
    CAST(sum(CASE WHEN tick = (SELECT max(tick) FROM ticks) THEN bps ELSE 0 END) AS BIGINT) AS bps
  FROM grid GROUP BY rule_type, list_rank, rule_no, text_rule)"""


def _totals(*columns: str) -> str:
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in columns)
    return (
        f"SELECT rule_type, rule_no, {', '.join(columns)} FROM per_rule "
        f"UNION ALL SELECT rule_type, NULL, {sums} FROM per_rule GROUP BY rule_type"
    )


def _size(value: str, unit: str) -> str:
    """Short size text: quotient plus last remainder over 1000, in single precision."""
    text = "CASE"
    for step in (5, 4, 3, 2, 1):
        whole = f"CAST({value} // {1000**step} AS FLOAT)"
        rest = f"CAST({value} // {1000 ** (step - 1)} % 1000 AS FLOAT) / CAST(1000 AS FLOAT)"
        prefix = "KMGTP"[step - 1]
        text += f" WHEN {value} >= {1000**step} THEN printf('%.2f', CAST({whole} + {rest} AS DOUBLE)) || '{prefix}{unit}'"
    return text + f" ELSE printf('%.2f', CAST({value} AS DOUBLE)) || '{unit}' END"


_AMOUNTS = (
    f"{_size('pps', 'p/s')} || ' (' || {_size('(bps * 8)', 'b/s')} || '), ' || "
    "CAST(packets AS VARCHAR) || ' packets, ' || CAST(bytes AS VARCHAR) || ' bytes'"
)

_SHOW = f"""
SELECT list_rank, CAST(rule_no AS BIGINT) AS position, lpad(CAST(rule_no AS VARCHAR), 5, ' ') || ':   ' ||
  rpad(text_rule, CAST((SELECT max(length(text_rule)) FROM per_rule w WHERE w.rule_type = r.rule_type) AS INTEGER), ' ')
  || '  : ' || {_AMOUNTS} AS line
FROM per_rule r
UNION ALL
SELECT list_rank, -1, upper(rule_type) || ' rules (num, rule, counter):' FROM per_rule GROUP BY list_rank, rule_type
UNION ALL
SELECT list_rank, 2147483648, 'Total: ' || {_AMOUNTS}
FROM (SELECT list_rank, CAST(sum(pps) AS BIGINT) AS pps, CAST(sum(bps) AS BIGINT) AS bps,
        CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM per_rule GROUP BY list_rank)"""


# A rule for every user and kind of event, in three rulesets.
_USER_HITS = """
pairs AS (SELECT DISTINCT user_id AS u, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4
    ELSE 5 END AS k FROM events),
shaped AS (SELECT 'set' || u % 3 AS ruleset_id, u, k, u * 5 + k AS line_no, (u * 5 + k) % 5 AS shape, 3325256704 + u % 256 AS s,
    3405803776 + u % 16 AS d, [80, 443, 53, 22][k % 4 + 1] AS port FROM pairs),
user_rules AS (SELECT ruleset_id, proto, next_rule, u, k, s, d, port, shape,
    row_number() OVER (PARTITION BY ruleset_id, proto ORDER BY line_no) - 1 AS rule_no
  FROM (SELECT *, CASE WHEN shape IN (0, 1) THEN 6 WHEN shape = 3 THEN 1 ELSE 17 END AS proto, shape IN (0, 3) AS next_rule FROM shaped)),
user_hits AS (SELECT p.pkt_id, r.ruleset_id, r.proto, r.rule_no, r.next_rule FROM packets p JOIN user_rules r ON p.proto = r.proto AND CASE
    WHEN shape = 0 AND u < 4 THEN p.dst_ip <> 0 AND p.tcp_flags & 16 = 16 AND p.win < k * 4096
    WHEN shape = 0 THEN p.src_ip = s AND p.dport = port
    WHEN shape = 1 THEN p.src_ip BETWEEN s - s % 4 AND s - s % 4 + 3 AND p.dst_ip BETWEEN d - d % 2 AND d - d % 2 + 1 AND p.tcp_hlen > 20 + k
    WHEN shape = 2 THEN p.src_ip BETWEEN s - s % 16 AND s - s % 16 + 15 AND p.udp_len > u % 100
    WHEN shape = 3 THEN p.dst_ip = d AND p.icmp_code = u % 3
    ELSE p.dst_ip = d AND p.dport = port END),
user_stops AS (SELECT pkt_id, ruleset_id, min(rule_no) AS stop FROM user_hits WHERE NOT next_rule GROUP BY ALL)"""

_USER_MATCHES = """SELECT pkt_id, ruleset_id, CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'icmp' END AS rule_type, CAST(rule_no AS INTEGER) AS rule_no
  FROM user_hits LEFT JOIN user_stops USING (pkt_id, ruleset_id) WHERE stop IS NULL OR rule_no <= stop"""

# Two rulesets whose versions come and go: each version's rules are walked on their own, from the tick after they came.
_VERSIONED = """
base(ruleset_id, rule_type, rule_no, proto, side, lo, hi, dlo, dhi, pps_base, bps_th, pps_period, bps_period, next_rule) AS (VALUES
 ('edge', 'tcp', 0, 6, 'd', 3405803776, 3405803791, 80, 443, 6, 0, 3, 10, TRUE),
 ('edge', 'tcp', 1, 6, 'd', 1, 4294967295, NULL, NULL, 10, 2000, 4, 6, FALSE),
 ('edge', 'udp', 0, 17, 'd', 3405803776, 3405804031, NULL, NULL, 2, 0, 1, 10, FALSE),
 ('core', 'tcp', 0, 6, 's', 3325256704, 3325256831, NULL, NULL, 5, 0, 2, 10, FALSE),
 ('core', 'icmp', 0, 1, 'd', 3405803776, 3405804031, NULL, NULL, 1, 0, 1, 10, FALSE)),
versions AS (SELECT ruleset_id, version, since, lead(since) OVER (PARTITION BY ruleset_id ORDER BY version) AS until
  FROM (SELECT v.ruleset_id, version, CASE WHEN version > 0 THEN start + v.later END AS since
    FROM (SELECT CAST(pkt_id // 2000 AS INTEGER) AS version, min(tick) AS start FROM packets GROUP BY ALL), (VALUES ('edge', 50), ('core', 109)) v(ruleset_id, later))),
book AS (SELECT b.*, v.version, v.since, v.until, b.pps_base + v.version % 3 AS pps_th FROM base b JOIN versions v USING (ruleset_id)),
v_hits AS (SELECT p.pkt_id, p.tick, p.dst_ip, p.frame_len, r.ruleset_id, r.version, r.rule_type, r.rule_no, r.next_rule FROM packets p JOIN book r
  ON p.proto = r.proto AND CASE WHEN side = 'd' THEN p.dst_ip ELSE p.src_ip END BETWEEN lo AND hi AND (dlo IS NULL OR p.dport BETWEEN dlo AND dhi)
   AND (since IS NULL OR p.tick >= since) AND (until IS NULL OR p.tick < until)),
v_stops AS (SELECT pkt_id, ruleset_id, version, min(rule_no) AS stop FROM v_hits WHERE NOT next_rule GROUP BY ALL),
v_matched AS (SELECT h.* FROM v_hits h LEFT JOIN v_stops s USING (pkt_id, ruleset_id, version) WHERE stop IS NULL OR rule_no <= stop),
v_ticks AS (SELECT ruleset_id, version, rule_type, rule_no, tick, count(*) AS pps, CAST(sum(frame_len) AS BIGINT) AS bps FROM v_matched GROUP BY ALL),
v_top AS (SELECT ruleset_id, version, rule_type, rule_no, tick, arg_max(dst_ip, n * 4294967296 - dst_ip) AS dst_ip
  FROM (SELECT ruleset_id, version, rule_type, rule_no, tick, dst_ip, count(*) AS n FROM v_matched GROUP BY ALL) GROUP BY ALL),
v_grid AS (SELECT r.*, t.tick, coalesce(k.pps, 0) AS pps, coalesce(k.bps, 0) AS bps
  FROM book r JOIN (SELECT unnest(range(0, (SELECT max(tick) + 1 FROM packets))) AS tick) t ON t.tick >= coalesce(since, 0) AND (until IS NULL OR t.tick < until)
  LEFT JOIN v_ticks k USING (ruleset_id, version, rule_type, rule_no, tick)),
v_walk AS (
SELECT ruleset_id, version, rule_type, rule_no, CAST(coalesce(since, 0) AS BIGINT) AS tick, CAST(-1000000 AS BIGINT) AS pps_good,
  CAST(-1000000 AS BIGINT) AS bps_good, CAST(NULL AS VARCHAR) AS fired FROM book
UNION ALL
SELECT ruleset_id, version, rule_type, rule_no, tick,
  CASE WHEN pps <= pps_th OR pps_fires THEN tick ELSE pps_good END,
  CASE WHEN bps_th > 0 AND NOT pps_fires AND (bps <= bps_th OR tick - bps_good > bps_period) THEN tick ELSE bps_good END,
  CASE WHEN pps_fires THEN 'pps' WHEN bps_th > 0 AND bps > bps_th AND tick - bps_good > bps_period THEN 'bps' END
FROM (SELECT g.*, w.pps_good, w.bps_good, g.pps > g.pps_th AND g.tick - w.pps_good > g.pps_period AS pps_fires
  FROM v_walk w JOIN v_grid g ON g.ruleset_id = w.ruleset_id AND g.version = w.version AND g.rule_type = w.rule_type AND g.rule_no = w.rule_no AND g.tick = w.tick + 1))"""

_VERSION_ALARMS = """SELECT w.ruleset_id, w.version, w.rule_type, w.rule_no, w.tick, w.fired AS trigger,
    concat_ws('.', dst_ip // 16777216, dst_ip // 65536 % 256, dst_ip // 256 % 256, dst_ip % 256) AS dst, pps, bps * 8 AS bps
  FROM v_walk w JOIN v_ticks USING (ruleset_id, version, rule_type, rule_no, tick) JOIN v_top USING (ruleset_id, version, rule_type, rule_no, tick)
  WHERE w.fired IS NOT NULL"""


# The rule lines made from `events`, and what each must become.
def _made(newer: bool) -> str:
    bump = "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END" if newer else "0"
    return f"""SELECT 'rs' || CAST(user_id % 7 AS VARCHAR) AS ruleset_id, event_id AS line_no, event_id % 8 AS shape,
    user_id AS u, user_id % 256 AS host, event_id AS e, 1 + CAST(FLOOR(value) AS BIGINT) + {bump} AS n,
    24 + user_id % 9 AS bits FROM events"""


def _rules_of(newer: bool = False) -> str:
    return f"""SELECT ruleset_id,
  CASE WHEN shape IN (0, 5, 7) THEN 'tcp' WHEN shape IN (1, 6) THEN 'udp' ELSE 'icmp' END AS rule_type,
  row_number() OVER (PARTITION BY ruleset_id,
    CASE WHEN shape IN (0, 5, 7) THEN 'tcp' WHEN shape IN (1, 6) THEN 'udp' ELSE 'icmp' END ORDER BY line_no) - 1 AS rule_no,
  CASE shape
    WHEN 0 THEN '-d 203.0.113.' || host || '/32 --pps-th ' || n || 'Kp --dport ' || u % 80 || '-443 --next '
    WHEN 1 THEN '--srcip=198.51.100.' || host || '/' || bits || ' --bps-th ' || n || 'Mb --hlen >' || u || ' '
    WHEN 2 THEN '-d10.' || host || '.0.0/16 --pps-th ' || n || 'p --type =8 --code <' || u % 16 || ' -a log:/var/log/' || u % 5 || '.log '
    WHEN 5 THEN '-d 203.0.113.' || u % 512 || ' --pps-th-per 7 --pps-th ' || n || 'p '
    WHEN 6 THEN '--dst 10.0.0.0/8 --bps-th ' || u % 16 || 'b '
    ELSE '-d 0.0.0.0/0 --pps-th 5p --tcp-flag S:1,A:0,S:' || u % 2 || ' -c user ' || u || ' --seq >' || e || ' ' END AS text_rule,
  CASE WHEN shape = 1 THEN 3325256704 + host - host % (1 << (32 - bits)) END AS src_lo,
  CASE WHEN shape = 1 THEN 3325256704 + host - host % (1 << (32 - bits)) + (1 << (32 - bits)) - 1 END AS src_hi,
  CASE shape WHEN 0 THEN 3405803776 + host WHEN 2 THEN 167772160 + host * 65536 WHEN 5 THEN 3405803776 + u % 512
    WHEN 6 THEN 167772160 WHEN 7 THEN 0 END AS dst_lo,
  CASE shape WHEN 0 THEN 3405803776 + host WHEN 2 THEN 167772160 + host * 65536 + 65535 WHEN 5 THEN 3405803776 + u % 512
    WHEN 6 THEN 184549375 WHEN 7 THEN 4294967295 END AS dst_hi,
  CASE WHEN shape = 0 THEN u % 80 END AS dport_lo, CASE WHEN shape = 0 THEN 443 END AS dport_hi,
  CASE WHEN shape = 7 THEN '>' END AS seq_op, CASE WHEN shape = 7 THEN e END AS seq_num,
  CASE WHEN shape = 1 THEN '>' END AS hlen_op, CASE WHEN shape = 1 THEN u END AS hlen_num,
  CASE WHEN shape = 7 THEN 16 * (u % 2) END AS flag_bits, CASE WHEN shape = 7 THEN 18 END AS flag_mask,
  CASE WHEN shape = 2 THEN '=' END AS type_op, CASE WHEN shape = 2 THEN 8 END AS type_num,
  CASE WHEN shape = 2 THEN '<' END AS code_op, CASE WHEN shape = 2 THEN u % 16 END AS code_num,
  CASE shape WHEN 0 THEN n * 1000 WHEN 2 THEN n WHEN 5 THEN n WHEN 7 THEN 5 ELSE 0 END AS pps_th,
  CASE shape WHEN 1 THEN n * 125000 WHEN 6 THEN (u % 16) // 8 ELSE 0 END AS bps_th,
  CASE WHEN shape = 5 THEN 7 ELSE 10 END AS pps_period, 10 AS bps_period,
  shape = 0 AS next_rule,
  CASE WHEN shape = 2 THEN 'log' ELSE 'syslog' END AS action_type,
  CASE WHEN shape = 2 THEN '/var/log/' || u % 5 || '.log' ELSE '' END AS action_param,
  CASE WHEN shape = 7 THEN 'user ' || u ELSE '' END AS comment
FROM ({_made(newer)})
WHERE shape IN (0, 1, 2, 7) OR (shape = 5 AND u % 512 < 256) OR (shape = 6 AND u % 16 >= 8)"""


_REJECTS = f"""SELECT ruleset_id, line_no,
  CASE shape WHEN 4 THEN 'SCTP -d 203.0.113.' || host || ' --pps-th ' || n || 'p'
    WHEN 5 THEN 'TCP -d 203.0.113.' || u % 512 || ' --pps-th-per 7 --pps-th ' || n || 'p'
    ELSE 'UDP --dst 10.0.0.0/8 --bps-th ' || u % 16 || 'b' END AS line,
  CASE shape WHEN 4 THEN 'unknown rule type: SCTP' WHEN 5 THEN 'bad dstip: 203.0.113.' || u % 512
    ELSE 'no pps or bps threshold' END AS reason
FROM ({_made(False)})
WHERE shape = 4 OR (shape = 5 AND u % 512 >= 256) OR (shape = 6 AND u % 16 < 8)"""

_DIFF_COLUMNS = """ruleset_id, rule_type, rule_no, src_lo, src_hi, dst_lo, dst_hi, dport_lo, dport_hi, seq_op, seq_num,
  hlen_op, hlen_num, flag_bits, flag_mask, type_op, type_num, code_op, code_num, pps_th, bps_th, pps_period, bps_period,
  next_rule"""

_DIFF = f"""WITH o AS (SELECT {_DIFF_COLUMNS} FROM ({_rules_of()})), n AS (SELECT {_DIFF_COLUMNS} FROM ({_rules_of(True)}))
SELECT 'old' AS side, ruleset_id, rule_type, rule_no, pps_th, bps_th FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)
UNION ALL
SELECT 'new', ruleset_id, rule_type, rule_no, pps_th, bps_th FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)"""

_METRIC_LINE = f"""SELECT measurement || ',' || CASE WHEN measurement = 'total' THEN 'type=' || type ELSE 'rule=' || rule END
  || ' pps=' || pps || ',bps=' || bps || ' ' || (tick + {EPOCH}) || '000000000' AS line FROM points"""

_POINT_COLUMNS = "SELECT tick, measurement, rule, type, pps, bps FROM points"

_DUE = "SELECT rule_type, rule_no, tick, pps, bps, trigger FROM alarms"


def _list_of(name: str) -> str:
    return _over("hits", f"SELECT pkt_id, rule_no FROM hits WHERE rule_type = '{name}'")


SQL = {
    "src_frames": _over("packets", f"SELECT {_PACKET_COLUMNS} FROM packets"),
    "src_packets": _over("packets", f"SELECT {_PACKET_COLUMNS} FROM packets"),
    "src_rules": _rules_of(),
    "src_rules_rejects": _REJECTS,
    "sink_alarm_log": _over(
        "alarms",
        """SELECT 'trigger alarm: ' || rule_type || '|' || dst || CASE WHEN comment = '' THEN '' ELSE '|' || comment END
           AS line, 'syslog' AS action_type, '' AS action_param FROM alarms""",
    ),
    "sink_metrics_lp": _over("points", _METRIC_LINE),
    "sink_event_lp": _over(
        "alarms",
        f"""SELECT 'events,dst=' || dst || ' bps=' || bps * 8 || ',pps=' || pps || ',type="' || rule_type
            || '",comment="' || comment || '" ' || (tick + {EPOCH}) || '000000000' AS line FROM alarms""",
    ),
    "sink_capture": _over(
        "alarms", f"SELECT {_CAPTURE_COLUMNS}, position FROM captured WHERE position <= 1000", _CAPTURE
    ),
    "sink_monitor": _over("points", _POINT_COLUMNS),
    "route_proto": _over(
        "packets",
        """SELECT pkt_id, CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'icmp' END AS rule_type
           FROM packets WHERE proto IN (6, 17, 1)""",
    ),
    "flt_ip_range": _over(
        "packets",
        """SELECT pkt_id, src_ip, dst_ip FROM packets
           WHERE src_ip BETWEEN 3325256704 AND 3325256831 AND dst_ip BETWEEN 1 AND 3405803783""",
    ),
    "flt_port_range": _over(
        "packets",
        "SELECT pkt_id, sport, dport FROM packets WHERE dport BETWEEN 1 AND 443 AND sport BETWEEN 1024 AND 3000",
    ),
    "flt_num_cmp": _over(
        "packets",
        """SELECT pkt_id, proto FROM packets
           WHERE (seq > 50000000 AND ack = 1000003 AND win < 8192 AND tcp_hlen = 24)
              OR udp_len > 100 OR (icmp_type = 8 AND icmp_code < 2)""",
    ),
    "flt_tcp_flags": _over("packets", "SELECT pkt_id, tcp_flags FROM packets WHERE (tcp_flags & 18) = 2"),
    "match_tcp": _list_of("tcp"),
    "match_udp": _list_of("udp"),
    "match_icmp": _list_of("icmp"),
    "join_rules_all": _over("hits", "SELECT pkt_id, rule_type, rule_no FROM hits"),
    "join_rules_first": _over("matched", _FIRST),
    "join_rules_first_indexed": _over("matched", _FIRST),
    "join_rules_first_joined": _over("matched", _FIRST),
    "join_rules_sets": _over("packets", _USER_MATCHES, _USER_HITS),
    "join_rules_sets_indexed": _over("packets", _USER_MATCHES, _USER_HITS),
    "join_rules_sets_joined": _over("packets", _USER_MATCHES, _USER_HITS),
    "semi_captured": _over("matched", "SELECT pkt_id FROM stops"),
    "anti_unmatched": _over(
        "matched", "SELECT pkt_id FROM packets p WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.pkt_id = p.pkt_id)"
    ),
    "asof_ruleset": _over(
        "packets",
        """SELECT pkt_id, tick, version, tick > valid_from AS evaluated FROM (
             SELECT p.pkt_id, p.tick, max(v.version) AS version, max(v.valid_from) AS valid_from
             FROM packets p JOIN (SELECT pkt_id // 2000 AS version, min(tick) + 50 AS valid_from FROM packets GROUP BY 1) v
               ON v.valid_from <= p.tick GROUP BY p.pkt_id, p.tick)""",
    ),
    "interval_capture": _over("alarms", f"SELECT {_CAPTURE_COLUMNS} FROM captured", _CAPTURE),
    "agg_rule_counters": _over(
        "grid",
        """SELECT rule_type, rule_no, CAST(sum(pps) AS BIGINT) AS packets, CAST(sum(bps) AS BIGINT) AS bytes
           FROM grid GROUP BY rule_type, rule_no""",
    ),
    "agg_rule_tick": _over("ticks", "SELECT rule_type, rule_no, tick, packets, bytes FROM ticks"),
    "agg_merge_partials": _over(
        "matched",
        """SELECT rule_type, rule_no, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes
           FROM matched GROUP BY rule_type, rule_no""",
    ),
    "agg_dst_counts": _over("ticks", "SELECT rule_type, rule_no, tick, dst_ip, packets FROM dst_counts"),
    "agg_merge_dst": _over("ticks", "SELECT rule_type, rule_no, tick, dst_ip, packets FROM dst_counts"),
    "agg_type_total": _over("grid", _totals("packets", "bytes", "pps", "bps"), _PER_RULE),
    "agg_running_total": _over(
        "ticks",
        """SELECT rule_type, rule_no, tick,
             CAST(sum(packets) OVER (PARTITION BY rule_type, rule_no ORDER BY tick) AS BIGINT) AS total_packets,
             CAST(sum(bytes) OVER (PARTITION BY rule_type, rule_no ORDER BY tick) AS BIGINT) AS total_bytes FROM ticks""",
    ),
    "ts_mean_1m_total": _over(
        "points",
        f"""SELECT (tick + {EPOCH}) // 60 * 60 AS time, type, avg(bps) AS mean_bps, avg(pps) AS mean_pps
            FROM points WHERE measurement = 'total' GROUP BY 1, 2""",
    ),
    "ts_mean_1m_rule": _over(
        "points",
        f"""SELECT (tick + {EPOCH}) // 60 * 60 AS time, measurement, rule, avg(bps) AS mean_bps, avg(pps) AS mean_pps
            FROM points WHERE measurement <> 'total' AND tick >= (SELECT max(tick) FROM points) - 1800 GROUP BY 1, 2, 3""",
    ),
    "ts_last_total": _over(
        "points", "SELECT type, arg_max(bps, tick) AS bps FROM points WHERE measurement = 'total' GROUP BY type"
    ),
    "ts_tag_values": _over("alarms", "SELECT DISTINCT dst FROM alarms"),
    "rate_delta": _over(
        "ticks",
        """SELECT rule_type, rule_no, sample_ms, CAST(round(packets / elapsed * 1000) AS BIGINT) AS pps,
             CAST(round(bytes / elapsed * 1000) AS BIGINT) AS bps
           FROM (SELECT *, CAST(sample_ms - coalesce(lag(sample_ms) OVER (PARTITION BY rule_type, rule_no ORDER BY sample_ms), 0)
                   AS DOUBLE) AS elapsed
                 FROM (SELECT *, tick * 1000 + 1000 + tick * 37 % 11 * 20 AS sample_ms FROM ticks))""",
    ),
    "trig_above": _over(
        "grid",
        """SELECT * FROM (SELECT rule_type, rule_no, tick, pps, bps, pps_th > 0 AND pps > pps_th AS pps_above,
             bps_th > 0 AND bps > bps_th AS bps_above FROM grid WHERE tick >= 1) WHERE pps_above OR bps_above""",
    ),
    "trig_single": _over("alarms", _DUE + " WHERE pps_th = 0 OR bps_th = 0"),
    "trig_dual": _over("alarms", _DUE + " WHERE pps_th > 0 AND bps_th > 0"),
    "trig_dst_guard": _over("alarms", _DUE + " WHERE pps_th = 0 OR bps_th = 0"),
    "top_dst": _over("ticks", "SELECT rule_type, rule_no, tick, dst FROM top_dst"),
    "ord_rules": _over("grid", _totals("packets", "bytes"), _PER_RULE),
    "topk_dst": _over(
        "ticks",
        """SELECT rule_type, rule_no, tick, dst_ip, packets, rank FROM (SELECT *, row_number() OVER
             (PARTITION BY rule_type, rule_no, tick ORDER BY packets DESC, dst_ip) AS rank FROM dst_counts) WHERE rank <= 3""",
    ),
    "limit_capture": _over(
        "alarms", f"SELECT {_CAPTURE_COLUMNS}, position FROM captured WHERE position <= 50", _CAPTURE
    ),
    "ts_event_history": _over(
        "alarms",
        f"""SELECT tick + {EPOCH} AS time, dst, bps * 8 AS bps, pps, rule_type AS protocol, comment,
              CASE WHEN bps * 8 >= 1000000000 THEN 2 WHEN bps * 8 >= 500000000 THEN 1 ELSE 0 END AS bps_severity,
              CASE WHEN pps >= 2000000 THEN 2 WHEN pps >= 1000000 THEN 1 ELSE 0 END AS pps_severity FROM alarms""",
    ),
    "union_types": _over(
        "matched",
        """SELECT rule_type, rule_no, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes
           FROM matched GROUP BY rule_type, rule_no""",
    ),
    "ruleset_diff": _DIFF,
    "rep_show_rules": _over("grid", _SHOW, _PER_RULE),
    "rep_alarms_versions": _over("packets", _VERSION_ALARMS, _VERSIONED),
    "rep_alarms": _over(
        "alarms",
        """SELECT tick, rule_type, rule_no, trigger, dst, pps, bps * 8 AS bps, comment, 'syslog' AS action_type,
             '' AS action_param,
             rule_type || '|' || dst || CASE WHEN comment = '' THEN '' ELSE '|' || comment END AS text FROM alarms""",
    ),
    # Streams: all there is, as in batch.
    "st_tick_counts": _over("ticks", "SELECT rule_type, rule_no, tick, packets, bytes FROM ticks"),
    "st_triggers": _over("alarms", "SELECT rule_type, rule_no, tick, pps, bps, dst, trigger FROM alarms"),
    "st_ruleset_reload": _over(
        "packets", "SELECT ruleset_id, version, rule_type, rule_no, tick, pps AS packets, bps AS bytes FROM v_ticks", _VERSIONED
    ),
    "st_alarms_reload": _over("packets", _VERSION_ALARMS, _VERSIONED),
    "st_monitor": _over("points", _POINT_COLUMNS),
    "st_capture": _over("alarms", f"SELECT {_CAPTURE_COLUMNS} FROM captured", _CAPTURE),
}
SQL["st_alarm_log"] = SQL["sink_alarm_log"]
SQL["rep_alarms_frames"] = SQL["rep_alarms"]
SQL["asof_ruleset_by_hour"] = SQL["asof_ruleset"]
