"""Column functions over packets: flags, names, entropy, credentials, severities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.schema import REDACTED, SEVERITIES

#: The letters of the TCP flag bits 0x01 to 0x80, in the order they are written.
FLAG_LETTERS = "FSRPAUEC"


def tcp_flags(bits: Column) -> Column:
    """Flag bits as letters in a fixed order; null and 0 give an empty string."""
    letters = [F.when(bits.bitwiseAND(F.lit(1 << n)) != 0, letter).otherwise("") for n, letter in enumerate(FLAG_LETTERS)]
    return F.coalesce(F.concat(*letters), F.lit(""))


def is_xmas(flags: Column) -> Column:
    return F.contains(flags, F.lit("F")) & F.contains(flags, F.lit("P")) & F.contains(flags, F.lit("U"))


def is_probe(flags: Column) -> Column:
    """Flags that a scan sends and ordinary traffic does not."""
    f = F.coalesce(flags, F.lit(""))
    return f.isin("S", "", "F") | is_xmas(f)


def parent_domain(name: Column) -> Column:
    """The last two labels of a name in lower case, dots around it left out."""
    return F.substring_index(F.trim(F.lower(name), F.lit(".")), ".", -2)


def entropy(s: Column) -> Column:
    """Base-2 entropy of the characters of a string; 0 if it is empty."""
    n = F.length(s)
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(0.0)


def max_label_length(name: Column) -> Column:
    return F.array_max(F.transform(F.split(name, r"\."), lambda x: F.length(x)))


def subdomain(name: Column) -> Column:
    """The labels before the last two, or the first label of a shorter name."""
    labels = F.split(name, r"\.")
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, 1, F.size(labels) - 2), ".")).otherwise(labels[0])


def allowlisted(name: Column, parent: Column, domains: list[str]) -> Column:
    """A name that is, or lies under, one of the domains; or whose parent is one."""
    clean = [d.lower().strip(".") for d in domains]
    low = F.lower(name)
    tests = [parent.isin(clean), *((low == d) | low.endswith("." + d) for d in clean)]
    return reduce(lambda a, b: a | b, tests) if clean else F.lit(False)


def or_default(value: Column, default) -> Column:
    """``default`` where the value is null, empty or 0."""
    return F.when(value.isNull() | (value.cast("string").isin("", "0")), F.lit(default)).otherwise(value)


def http_basic(payload: Column, mask_opaque: bool = False) -> Column:
    """Username and masked password of HTTP Basic credentials anywhere in a payload, else null.

    A token that isn't Base64 gives the username ``unknown``; one without a colon is the
    username as a whole, or is masked if ``mask_opaque`` is set.
    """
    found = payload.rlike(r"(?i)Authorization:\s*Basic\s+[A-Za-z0-9+/=]+")
    token = F.regexp_extract(payload, r"(?i)Authorization:\s*Basic\s+([A-Za-z0-9+/=]+)", 1)
    raw = F.when(F.length(token) % 4 == 0, F.try_to_binary(token, F.lit("base64")))
    plain = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))
    name = F.substring_index(plain, ":", 1)
    if mask_opaque:
        name = F.when(F.contains(plain, F.lit(":")), name).otherwise(REDACTED)
    return F.when(found, F.struct(F.coalesce(name, F.lit("unknown")).alias("username"), F.lit(REDACTED).alias("password")))


def ftp_command(payload: Column, src_port: Column, dst_port: Column) -> Column:
    """The last USER or PASS line of an FTP payload, passwords masked, else null."""
    applies = (src_port == 21) | (dst_port == 21) | payload.rlike("^(USER |PASS |user |pass )")
    lines = F.filter(F.split(payload, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85]"), lambda x: x.rlike(r"(?i)^(USER|PASS)\s+"))
    line = F.try_element_at(lines, F.lit(-1))
    cmd = F.upper(F.regexp_extract(line, r"(?i)^(USER|PASS)\s+(.*)", 1))
    arg = F.trim(F.regexp_extract(line, r"(?i)^(USER|PASS)\s+(.*)", 2))
    return F.when(F.coalesce(applies, F.lit(False)) & line.isNotNull(), F.struct(cmd.alias("cmd"), F.when(cmd == "PASS", REDACTED).otherwise(arg).alias("arg")))


def gratuitous(op: Column, psrc: Column, pdst: Column, hwdst: Column) -> Column:
    return F.coalesce((op == 2) & ((psrc == pdst) | F.lower(hwdst).isin("ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00")), F.lit(False))


def severity_rank(severity: Column) -> Column:
    """3, 2, 1 for HIGH, MEDIUM, LOW: severities are ordered by this and never as strings."""
    return F.coalesce(*(F.when(severity == s, len(SEVERITIES) - n) for n, s in enumerate(SEVERITIES)))


def severity_of(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in reversed(SEVERITIES))), rank)


def seconds(us: Column) -> Column:
    return us / F.lit(1_000_000.0)


#: Domains of an allowlist up to which each is a term of an expression.
FEW_DOMAINS = 64


def without_allowed(rows: DataFrame, name: str, parent: str, domains: list[str]) -> DataFrame:
    """Rows whose name is neither one of the domains nor under one, nor has one for its parent.

    Of a long list no expression is made: distinct names are exploded into their suffixes and
    joined with the domains, which Spark broadcasts only if they are small, and the rows of
    the names that were found are left out.
    """
    clean = sorted({d.lower().strip(".") for d in domains})
    if len(clean) <= FEW_DOMAINS:
        return rows.where(~allowlisted(F.col(name), F.col(parent), clean))
    labels = F.split(F.lower(name), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.select(name, parent).distinct().select(name, parent, F.explode(F.array_union(suffixes, F.array(F.col(parent)))).alias("domain"))
    known = rows.sparkSession.createDataFrame([(d,) for d in clean], "domain string")
    return rows.join(asked.join(known, "domain").select(name, parent).distinct(), [name, parent], "left_anti")
