"""The correlation step of one directive and key: which backlogs an event feeds, and what that emits.

Strictly serial: events come in order of (ts_unix, seq); ``step`` expires, offers, advances and opens, in that
order.  State is a plain list of ``Backlog``, so the same step serves batch groups and streaming state.  Asset lookups
are not done here: events carry src_home, dst_home, src_value, dst_value, src_name and dst_name.

Where ``alarms`` is False only the links of alarms to events are emitted: rows of kind ``alarm`` and what they alone hold are
not made, and values, names and custom labels are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from wardline.functions.match import address_in_list, reference, text_matches, value_in_list
from wardline.plans.directives import ANYWHERE, Directive, Rule

ORDER_SLACK = 5


@dataclass
class Backlog:
    id: str
    title: str
    rules: list[Rule]
    stage: int = 1
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    status: list[str] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    seen: list[list[str]] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    src_ips: list[str] = field(default_factory=list)
    dst_ips: list[str] = field(default_factory=list)
    custom: list[tuple[str, str]] = field(default_factory=list)
    value: int = 0
    risk: int = 0
    created: int = 0
    updated: int = 0
    src_port: int = 0
    dst_port: int = 0

    def dump(self) -> dict:
        return asdict(self)

    @staticmethod
    def load(raw: dict) -> Backlog:
        return Backlog(**(raw | {"rules": [Rule(**r) for r in raw["rules"]], "custom": [tuple(c) for c in raw["custom"]]}))


def sticky_value(r: Rule, e: dict) -> str | None:
    kind = r.sticky_different
    return str(e[kind.lower()]) if kind in ("PLUGIN_SID", "SRC_IP", "DST_IP", "SRC_PORT", "DST_PORT", "CUSTOM_DATA1", "CUSTOM_DATA2", "CUSTOM_DATA3") else None


_SIDES = (("from_", "src_ip", "src_home"), ("to", "dst_ip", "dst_home"))
_PORTS = (("port_from", "src_port"), ("port_to", "dst_port"))
_CUSTOM = ("custom_data1", "custom_data2", "custom_data3")


def _see(e: dict, r: Rule, seen: list[str] | None) -> None:
    v = sticky_value(r, e)
    if seen is not None and v is not None and v not in seen:
        seen.append(v)


def matches(e: dict, r: Rule, seen: list[str] | None) -> bool:
    """Does the event match?  A sticky value is noted in ``seen`` as soon as the tests before it have passed."""
    sticky = r.sticky_different
    if r.type == "PluginRule":
        if e["plugin_sid"] not in r.plugin_sid or e["plugin_id"] != r.plugin_id:
            return False
        if sticky == "PLUGIN_SID":
            _see(e, r, seen)
    elif r.type == "TaxonomyRule":
        if e["category"] != r.category or e["product"] not in r.product:
            return False
        if r.subcategory and "ANY" not in r.subcategory and e["subcategory"] not in r.subcategory:
            return False
    else:
        return False
    for attr, ip, home in _SIDES:
        rule = getattr(r, attr)
        if rule == "ANY":
            continue
        ok = e[home] == (rule == "HOME_NET") if rule in ANYWHERE else address_in_list(e[ip], rule)
        if not ok:
            return False
    for attr, port in _PORTS:
        rule = getattr(r, attr)
        if rule != "ANY" and not value_in_list(str(e[port]), rule):
            return False
    if sticky in ("SRC_IP", "DST_IP", "SRC_PORT", "DST_PORT"):
        _see(e, r, seen)
    if r.type == "TaxonomyRule":
        return True
    ok = True
    for attr in _CUSTOM:
        rule = getattr(r, attr)
        if rule not in ("", "ANY") and not text_matches(e[attr], rule):
            ok = False
            break
    if sticky.startswith("CUSTOM_DATA"):
        _see(e, r, seen)
    return ok


def resolved(d: Directive, e: dict) -> list[Rule]:
    """The rules with references replaced: by the referred rule's list, or by the event's value where that is open."""
    rules = list(d.rules)  # a rule is copied where it changes

    def put(i: int, attr: str, value: str) -> None:
        if rules[i] is d.rules[i]:
            rules[i] = Rule.__new__(Rule)
            rules[i].__dict__.update(d.rules[i].__dict__)
        setattr(rules[i], attr, value)

    fields = [("from_", ANYWHERE, e["src_ip"]), ("to", ANYWHERE, e["dst_ip"]), ("port_from", ("ANY",), str(e["src_port"])), ("port_to", ("ANY",), str(e["dst_port"]))]
    fields += [(f"custom_data{k}", ("ANY",), e[f"custom_data{k}"]) for k in (1, 2, 3)]
    if d.all_rules_always_active:
        for attr, _, value in fields[:2]:
            if getattr(rules[0], attr) in ANYWHERE:
                put(0, attr, value)
    for i, r in enumerate(d.rules[1:], 1):
        for attr, wild, value in fields:
            own = getattr(r, attr)
            k = reference(own) if ":" in own else None
            if k is not None and 1 <= k <= len(rules):
                there = getattr(rules[k - 1], attr)
                put(i, attr, value if there in wild else there)
    return rules


def open_backlog(d: Directive, e: dict, seq: int, alarms: bool = True) -> Backlog:
    n = len(d.rules)
    title = d.name.replace("SRC_IP", e["src_name"] or e["src_ip"]).replace("DST_IP", e["dst_name"] or e["dst_ip"]) if alarms else ""
    key = hashlib.sha256(f"{d.id}|{e['event_id']}|{seq}".encode()).hexdigest()[:16]
    return Backlog(key, title, resolved(d, e), 1, [e["ts_unix"]] + [0] * (n - 1), [0] * n, [""] * n, [0] * n, [[] for _ in range(n)])


def alarm_row(d: Directive, b: Backlog, seq: int) -> dict:
    rules = [
        {"stage": r.stage, "name": r.name, "status": s, "start_time": lo, "end_time": hi, "events": c, "from": r.from_, "to": r.to, "port_from": r.port_from, "port_to": r.port_to}
        for r, s, lo, hi, c in zip(b.rules, b.status, b.start, b.end, b.count)
    ]
    return {
        "kind": "alarm", "directive_id": d.id, "alarm_id": b.id, "stage": b.stage, "event_id": None, "seq": seq, "title": b.title, "kingdom": d.kingdom, "category": d.category,
        "status": b.status[b.stage - 1] or "active", "created_time": b.created, "update_time": b.updated, "risk": b.risk, "src_ips": list(b.src_ips), "dst_ips": list(b.dst_ips),
        "custom_data": [{"label": x, "content": y} for x, y in b.custom], "src_port": b.src_port, "dst_port": b.dst_port, "rules": rules,
    }


def _append(d: Directive, b: Backlog, e: dict, i: int, seq: int, alarms: bool) -> dict:
    b.count[i] += 1
    b.ids.append(e["event_id"])
    if alarms:
        _note(b, e)
    return {"kind": "event", "directive_id": d.id, "alarm_id": b.id, "stage": i + 1, "event_id": e["event_id"], "seq": seq}


def _note(b: Backlog, e: dict) -> None:
    """What alarms show of a counted event."""
    for ips, ip in ((b.src_ips, e["src_ip"]), (b.dst_ips, e["dst_ip"])):
        if ip not in ips:
            ips.append(ip)
        if len(ips) > 1 and "0.0.0.0" in ips:
            ips.remove("0.0.0.0")
    for k in (1, 2, 3):
        pair = (e[f"custom_label{k}"], e[f"custom_data{k}"])
        if all(pair) and pair not in b.custom:
            b.custom.append(pair)
    b.value = max(b.value, e["src_value"], e["dst_value"])
    b.src_port, b.dst_port = e["src_port"], e["dst_port"]
    b.updated = e["ts_unix"]
    b.created = b.created or e["ts_unix"]


def _advance(d: Directive, b: Backlog, e: dict, seq: int, alarms: bool) -> Iterator[dict]:
    """Counts the event in the current stage, and moves on when the stage is full."""
    i = b.stage - 1
    yield _append(d, b, e, i, seq, alarms)
    r = b.rules[i]
    if b.count[i] < r.occurrence:
        return
    b.status[i], b.end[i] = "finished", e["ts_unix"]
    b.risk = d.priority * r.reliability * b.value // 25
    if b.stage < len(b.rules):
        b.stage += 1
        b.start[b.stage - 1] = e["ts_unix"]
    if alarms:
        yield alarm_row(d, b, seq)


def done(b: Backlog) -> bool:
    return b.status[-1] == "finished"


def expire(d: Directive, live: list[Backlog], now: int, life: int, seq: int, alarms: bool = True) -> Iterator[dict]:
    """Takes out the backlogs whose stage has run out of time before ``now``."""
    for b in [b for b in live if b.start[b.stage - 1] + b.rules[b.stage - 1].timeout < now - life]:
        b.status[b.stage - 1] = "timeout"
        _drop(live, b)
        if alarms:
            yield alarm_row(d, b, seq)


def _drop(live: list[Backlog], b: Backlog) -> None:
    """Takes out the backlog itself, not the first that looks alike."""
    del live[next(i for i, x in enumerate(live) if x is b)]


def step(d: Directive, live: list[Backlog], e: dict, seq: int, life: int = 0, alarms: bool = True) -> Iterator[dict]:
    """One event.  life: seconds that alarms are kept beyond their stage's timeout."""
    ts = e["ts_unix"]
    if ts is not None and live:
        yield from expire(d, live, ts, life, seq, alarms)
    consumed = False
    for b in list(live):
        i = b.stage - 1
        r, before = b.rules[i], len(b.seen[i])
        if not matches(e, r, b.seen[i]):
            if d.all_rules_always_active:
                k = next((k for k in range(i) if matches(e, b.rules[k], b.seen[k])), None)
                if k is not None:
                    consumed = True
                    yield _append(d, b, e, k, seq, alarms)
                    if alarms:
                        yield alarm_row(d, b, seq)
            continue
        consumed = True
        if r.sticky_different and len(b.seen[i]) == before:
            continue
        if ts is None or (i and b.end[i - 1] >= ts + ORDER_SLACK):
            continue
        yield from _advance(d, b, e, seq, alarms)
        if done(b):
            _drop(live, b)
    if consumed or ts is None or not matches(e, d.rules[0], None) or any(e["event_id"] in b.ids for b in live):
        return
    b = open_backlog(d, e, seq, alarms)
    live.append(b)
    yield from _advance(d, b, e, seq, alarms)
    if done(b):
        _drop(live, b)
