"""IP addresses and CIDR blocks on Column expressions."""

from __future__ import annotations

import ipaddress
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolwarden.functions.text import any_of

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"


def ipv4_number(address: Column) -> Column:
    """Dotted address as BIGINT; NULL for anything else."""
    parts = F.split(address, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(parts, i).cast("bigint")
    return F.when(F.rlike(address, F.lit(_IPV4)), number)


def ipv6_bits(address: Column) -> Column:
    """IPv6 address as 32 lower-case hex digits; NULL for anything else.

    ``::`` stands for as many zero groups as are missing.
    """
    low = F.lower(address)
    halves = F.split(low, "::")

    def groups(half: Column) -> Column:
        found = F.filter(F.split(half, ":"), lambda g: g != F.lit(""))
        return F.transform(found, lambda g: F.lpad(g, 4, "0"))

    head = groups(F.get(halves, 0))
    tail = F.coalesce(groups(F.get(halves, 1)), F.array().cast("array<string>"))
    missing = 8 - F.size(head) - F.size(tail)
    digits = F.concat(
        F.array_join(head, ""),
        F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0))),
        F.array_join(tail, ""),
    )
    group = r"[0-9a-f]{1,4}"
    full = rf"\A{group}(?::{group}){{7}}\z"
    short = rf"\A(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?\z"
    valid = F.rlike(low, F.lit(full)) | (F.rlike(low, F.lit(short)) & (missing >= 1))
    return F.when(valid, digits)


def in_trusted(address: Column, trusted: list[str]) -> Column:
    """Is the address listed, exactly or by a CIDR block?

    Blocks are grouped by prefix length, so an address costs one hash lookup
    per distinct length, however long the list is.  Entries that are no valid
    block are skipped; an empty list trusts every address, even a missing one.
    """
    if not trusted:
        return F.lit(True)
    exact = [t for t in trusted if "/" not in t]
    v4: dict[int, set[int]] = defaultdict(set)
    v6: dict[int, set[str]] = defaultdict(set)
    for entry in trusted:
        if "/" not in entry:
            continue
        try:
            block = ipaddress.ip_network(entry, strict=False)
        except ValueError:
            continue
        number = int(block.network_address)
        if block.version == 4:
            v4[block.prefixlen].add(number >> (32 - block.prefixlen))
        else:
            v6[block.prefixlen].add(f"{number:0128b}"[: block.prefixlen])
    tests = [address.isin(exact)] if exact else []
    number = ipv4_number(address)
    for length, blocks in sorted(v4.items()):
        tests.append(F.shiftright(number, 32 - length).isin(sorted(blocks)))
    if v6:
        bits = _binary(ipv6_bits(address))
        for length, prefixes in sorted(v6.items()):
            tests.append(F.left(bits, F.lit(length)).isin(sorted(prefixes)))
    return F.coalesce(any_of([F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))


def _binary(digits: Column) -> Column:
    """Binary digits of a 32-digit hex string."""
    pieces = [
        F.lpad(F.conv(F.substring(digits, 8 * i + 1, 8), 16, 2), 32, "0") for i in range(4)
    ]
    return F.concat(*pieces)
