"""IP addresses as columns: numeric forms, CIDR bounds, private ranges, address lists.

IPv4 addresses are LONG columns, IPv6 ones strings of 32 lower-case hexadecimal digits, which compare like the numbers
they stand for.  Both are built-in expressions, so a filter on them stays in the JVM.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

V4 = r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"
#: Private and local ranges.
PRIVATE_V4 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")
PRIVATE_V6 = ("::1/128", "fe80::/10", "fc00::/7")


def ip_to_long(ip: Column | str) -> Column:
    """An IPv4 address as LONG; NULL for anything else."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    part = F.split(ip, r"\.")
    octets = [F.element_at(part, i).cast("bigint") for i in range(1, 5)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ip.rlike(V4) & (F.greatest(*octets) <= 255), value)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once and stands in the plan once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ip6_to_hex(ip: Column | str) -> Column:
    """An IPv6 address as 32 hexadecimal digits; NULL for anything else."""
    ip = F.col(ip) if isinstance(ip, str) else ip

    def groups(t: Column) -> Column:
        """The text with a last part in IPv4 form as two groups."""
        last = F.substring_index(t, ":", -1)
        low = F.regexp_replace(F.lpad(F.lower(F.hex(ip_to_long(last))), 8, "0"), "^(.{4})", "$1:")
        return F.when(F.contains(last, F.lit(".")), F.concat(F.left(t, F.length(t) - F.length(last)), low)).otherwise(t)

    def digits(t: Column) -> Column:
        # no group is empty but for the gap, which stands for one at least
        plain = t.rlike("^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$")
        wide = F.regexp_replace(F.regexp_replace(t, "([0-9a-f]+)", "000$1"), "[0-9a-f]*([0-9a-f]{4})(?![0-9a-f])", "$1")

        def filled(w: Column) -> Column:
            held = F.length(F.replace(w, F.lit(":"), F.lit("")))
            whole = F.when(F.contains(w, F.lit("::")), held <= 28).otherwise(held == 32)
            return F.when(whole, F.replace(F.replace(w, F.lit("::"), F.repeat(F.lit("0"), 32 - held)), F.lit(":"), F.lit("")))

        return F.when(plain, bound(wide, filled))

    return F.when(F.contains(ip, F.lit(":")), bound(F.lower(ip), lambda t: bound(groups(t), digits)))


@dataclass(frozen=True)
class Net:
    """A network, by its bounds as integers; version 4 or 6."""

    version: int
    lo: int
    hi: int
    prefix: int

    def has(self, address: tuple[int, int] | None) -> bool:
        return address is not None and address[0] == self.version and self.lo <= address[1] <= self.hi


def net(text: str) -> Net | None:
    """A CIDR, host bits allowed; an address without a mask gets /32 whatever its version.  None if it can't be read."""
    text = text.strip()
    try:
        n = ipaddress.ip_network(text if "/" in text else f"{text}/32", strict=False)
    except ValueError:
        return None
    return Net(n.version, int(n.network_address), int(n.broadcast_address), n.prefixlen)


def address(text: str | None) -> tuple[int, int] | None:
    try:
        a = ipaddress.ip_address(text or "")
    except ValueError:
        return None
    return a.version, int(a)


def items(csv: str) -> list[tuple[bool, str]]:
    """(negated, value) of a list parted by commas and white space."""
    return [(w.startswith("!"), w[1:].strip() if w.startswith("!") else w) for w in csv.replace(",", " ").split()]


def over(ip: Column | str, nets: list[Net], f: Callable[[Callable[[Net], Column], Column], Column]) -> Column:
    """f(holds, known): holds(net) is whether the address is in a network, NULL or FALSE for what is no address of its version,
    and known whether it is an address.  Where a network is an IPv6 one the address is read once for all of them.
    """

    def given(v4: Column, v6: Column) -> Column:
        return f(lambda n: v4.between(n.lo, n.hi) if n.version == 4 else v6.between(f"{n.lo:032x}", f"{n.hi:032x}"), v4.isNotNull() | v6.isNotNull())

    if all(n.version == 4 for n in nets):
        return given(ip_to_long(ip), ip6_to_hex(ip))
    return bound(ip_to_long(ip), lambda v4: bound(ip6_to_hex(ip), lambda v6: given(v4, v6)))


def in_nets(ip: Column | str, cidrs: tuple[str, ...] | list[str]) -> Column:
    """Is an address in any of the networks?  FALSE for what is no address."""
    nets = [n for n in map(net, cidrs) if n]

    def found(holds: Callable[[Net], Column], _: Column) -> Column:
        out = F.lit(False)
        for n in nets:
            out = out | F.coalesce(holds(n), F.lit(False))
        return out

    return over(ip, nets, found)


def is_private(ip: Column | str) -> Column:
    """NULL where the text is no address."""
    return F.when(ip_to_long(ip).isNotNull(), in_nets(ip, PRIVATE_V4)).when(ip6_to_hex(ip).isNotNull(), in_nets(ip, PRIVATE_V6))


def is_private_any(ip: str) -> bool | None:
    """Both versions, for single values."""
    a = address(ip)
    return None if a is None else any(net(c).has(a) for c in (*PRIVATE_V4, *PRIVATE_V6))


def address_in_list(ip: Column | str, csv: str) -> Column:
    """A rule's address list over a column of addresses.

    The first item that holds the address decides; without one, the list passes if it has a negated item.  An item
    that can't be read fails the address where it is reached, and what is no address never passes.
    """
    rules, rest = [], any(neg for neg, _ in items(csv))
    for neg, text in items(csv):
        n = net(text)
        if n is None:
            rest = False
            break
        rules.append((neg, n))

    def first(holds: Callable[[Net], Column], known: Column) -> Column:
        out = None
        for neg, n in rules:
            hit = holds(n)
            out = F.when(hit, F.lit(not neg)) if out is None else out.when(hit, F.lit(not neg))
        # where nothing holds it, a list with a negated item passes what is an address
        left = known if rest else F.lit(False)
        return F.coalesce(left if out is None else out.otherwise(left), F.lit(False))

    return over(ip, [n for _, n in rules], first)
