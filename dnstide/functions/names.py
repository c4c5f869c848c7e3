"""Labels and names: record types, response codes, domain and client names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in their own order.
RTYPES = ("A", "MX", "AAAA", "CNAME", "NS", "SOA", "TXT", "SPF", "SRV", "DNAME", "NAPTR", "OTHER")
RCODES = ("NOERROR", "FORMATERR", "SERVFAIL", "NXDOMAIN", "NOTIMP", "REFUSED", "OTHER")
MAX_NAME, MAX_KEY = 32, 64


def rtype_label(c: Column) -> Column:
    return F.when(c.isin(*RTYPES), c).otherwise("OTHER")


def rcode_label(c: Column) -> Column:
    return F.when(c.isin(*RCODES), c).otherwise("OTHER")


def label_place(c: Column, labels: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in labels)), c)


def full_name(c: Column) -> Column:
    """The name with its root dot; null if it has 32 bytes or more before the dot is added."""
    return F.when(F.octet_length(c) < MAX_NAME, F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit("."))))


def without_root(c: Column) -> Column:
    return F.substring(c, F.lit(1), F.char_length(c) - 1)


def view_key(view: Column, zone: Column) -> Column:
    return F.concat(view, F.lit("$"), zone)


def valid_key(key: Column) -> Column:
    return F.octet_length(key) <= MAX_KEY


def ancestors(name: Column) -> Column:
    """Array of the full name itself and its ancestors, nearest first, down to the root dot: what is left after each
    dot in turn, so that an empty label counts as one."""
    labels = F.split(without_root(name), r"\.")
    suffix = lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("."))
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), suffix), F.array(F.lit("."))))
