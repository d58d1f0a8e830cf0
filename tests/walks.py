"""Plain Python definitions that the Spark operators are tested against."""

PROTO = {"tcp": 6, "udp": 17, "icmp": 1}
RANGES = {"tcp": ["src", "dst", "sport", "dport"], "udp": ["src", "dst", "sport", "dport"], "icmp": ["src", "dst"]}
COMPARED = {
    "tcp": {"seq": "seq", "ack": "ack", "win": "win", "hlen": "tcp_hlen"},
    "udp": {"hlen": "udp_len"},
    "icmp": {"type": "icmp_type", "code": "icmp_code"},
}


def matches(rule, packet):
    kind = rule["rule_type"]
    if packet["proto"] != PROTO[kind]:
        return False
    for name in RANGES[kind]:
        lo, hi = rule[f"{name}_lo"], rule[f"{name}_hi"]
        value = packet[f"{name}_ip" if name in ("src", "dst") else name]
        if lo is not None and not (value != 0 and lo <= value <= hi):
            return False
    for name, field in COMPARED[kind].items():
        op, num = rule[f"{name}_op"], rule[f"{name}_num"]
        value = packet[field]
        if op is not None and not {"=": value == num, ">": value > num, "<": value < num}[op]:
            return False
    if kind == "tcp" and rule["flag_mask"] is not None:
        return packet["tcp_flags"] & rule["flag_mask"] == rule["flag_bits"]
    return True


def first_match(rules, packet):
    """(rule_type, rule_no) of every rule that counts the packet, and whether one ended the walk."""
    hits = []
    for rule in sorted(rules, key=lambda r: r["rule_no"]):
        if matches(rule, packet):
            hits.append((rule["rule_type"], rule["rule_no"]))
            if not rule["next_rule"]:
                return hits, True
    return hits, False


def alarms(rates, first, last, pps_th, bps_th, pps_period, bps_period):
    """Alarms of one rule; `rates` maps a tick to (pps, bps); other ticks have rate 0."""
    pps_good = bps_good = -(10**9)
    fired = []
    for tick in range(first, last + 1):
        pps, bps = rates.get(tick, (0, 0))
        if pps_th > 0:
            if pps > pps_th:
                if tick - pps_good > pps_period:
                    pps_good = tick
                    fired.append((tick, "pps"))
                    continue
            else:
                pps_good = tick
        if bps_th > 0:
            if bps > bps_th:
                if tick - bps_good > bps_period:
                    bps_good = tick
                    fired.append((tick, "bps"))
            else:
                bps_good = tick
    return fired
