"""Address and link safety, mail addresses, passwords, image signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.strings import has_any, let, wide_trim
from skein.functions.url import host_of

# ---- fixed values ----------------------------------------------------------------------------------------------------
MAX_URL = 2048
#: IPv6 prefixes that are not public; compared as text, before a look for colons.
V6_PREFIXES = ["fe80:", "fe8", "fe9", "fea", "feb", "fc", "fd", "ff", "64:ff9b:"]
V6_RESERVED = ["2001:db8", "100:"]
#: IPv4 ranges that are not public, as first and last address.
V4_RANGES = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.88.99.0", "192.88.99.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
]
INTERNAL_HOSTS = ["localhost", "169.254.169.254", "metadata.google.internal"]
INTERNAL_SUFFIXES = [".local", ".internal", ".lan"]
EMAIL = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+"
ASK, FORMAT = "Please enter a valid email address.", "Please enter a valid email address format."
REQUIRED, TOO_LONG = "Email address is required.", "Email address exceeds maximum length of 254 characters."
LOCAL_LONG, BAD_TLD = "Email local part cannot exceed 64 characters.", "Email contains an invalid top-level domain."
# ----------------------------------------------------------------------------------------------------------------------


def v4_number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_private_ip(ip: Column) -> Column:
    """IP1: whether an address is private, reserved or malformed; an empty part counts as 0."""

    def v4(v: Column) -> Column:
        parts = F.transform(F.split(v, r"\."), lambda p: F.when(F.trim(p) == "", F.lit(0)).when(F.trim(p).rlike(r"^[0-9]{1,9}\z"), F.trim(p).try_cast("long")))
        bad = (F.size(parts) != 4) | F.exists(parts, lambda p: p.isNull() | (p > 255))
        number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p)
        reserved = F.lit(False)
        for low, high in V4_RANGES:
            reserved = reserved | number.between(v4_number(low), v4_number(high))
        return F.when(bad, F.lit(True)).otherwise(reserved)

    def run(v: Column) -> Column:
        starts = lambda prefixes: F.lit(False) if not prefixes else v.startswith(prefixes[0]) | starts(prefixes[1:])
        return F.when(v.isin("::", "::1") | starts(V6_PREFIXES), F.lit(True)).when(v.contains(":"), starts(V6_RESERVED)).otherwise(v4(v))

    return F.coalesce(let(F.regexp_replace(F.lower(wide_trim(ip)), "^::ffff:", ""), run), F.lit(True))


def is_internal_host(host: Column) -> Column:
    out = host.isin(INTERNAL_HOSTS) | host.rlike(r"^(?:0x[0-9a-f]+|[0-9]+)\z")
    for s in INTERNAL_SUFFIXES:
        out = out | host.endswith(s)
    return out


def is_safe_url(url: Column, ip: Column, any_private: Column | None = None) -> Column:
    """IP2, IP4: http(s), at most 2048 characters, no internal host, and an address that is known and public, as are all others of the
    host (any_private)."""
    host = host_of(url)
    safe = (F.length(url) <= MAX_URL) & host.isNotNull() & ~is_internal_host(host) & ip.isNotNull() & ~(is_private_ip(ip) if any_private is None else any_private)
    return F.coalesce(safe, F.lit(False))


def url_problem(url: Column) -> Column:
    """Why a request is refused: missing or too_long; null if it may go on."""
    blank = url.isNull() | (wide_trim(url) == "")
    return F.when(blank, F.lit("missing")).when(F.length(url) > MAX_URL, F.lit("too_long"))


def mail_domain(mail: Column) -> Column:
    return F.substring_index(F.lower(wide_trim(mail)), "@", -1)


def parent_domains(domain: Column) -> Column:
    """A domain and those above it, so that suffixes can be looked up by an equality join."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def validate_email(mail: Column, disposable: Column) -> Column:
    """EM1: struct(is_valid, is_disposable, error, normalized, domain). disposable: whether the domain, or one above it, is listed."""

    def run(v: Column) -> Column:
        domain, local = F.substring_index(v, "@", -1), F.left(v, F.length(v) - F.length(F.substring_index(v, "@", -1)) - 1)
        tld = F.substring_index(domain, ".", -1)
        shapeless = ~v.contains("@") | (local == "") | (domain == "")
        error = (
            F.when(v == "", F.lit(ASK)).when(F.length(v) > 254, F.lit(TOO_LONG)).when(shapeless, F.lit(ASK)).when(F.length(local) > 64, F.lit(LOCAL_LONG))
            .when(~v.rlike(EMAIL + r"\z"), F.lit(FORMAT)).when(~tld.rlike(r"^[a-z]{2,}\z"), F.lit(BAD_TLD)).when(F.coalesce(disposable, F.lit(False)), F.lit(ASK))
        )
        known = ~shapeless & (F.length(v) <= 254)
        clean = v.rlike(EMAIL + r"\z") & tld.rlike(r"^[a-z]{2,}\z") & (F.length(local) <= 64) & known
        return F.struct(
            error.isNull().alias("is_valid"), (clean & F.coalesce(disposable, F.lit(False))).alias("is_disposable"), error.alias("error"),
            v.alias("normalized"), F.when(known, domain).otherwise(F.lit("")).alias("domain"),
        )

    none = F.struct(F.lit(False).alias("is_valid"), F.lit(False).alias("is_disposable"), F.lit(REQUIRED).alias("error"), F.lit("").alias("normalized"), F.lit("").alias("domain"))
    return F.when(mail.isNull() | (mail == ""), none).otherwise(let(F.lower(wide_trim(mail)), run))


def password_ok(c: Column) -> Column:
    """EM2: at least 8 characters with a small letter, a capital and a digit."""
    return F.coalesce((F.length(c) >= 8) & c.rlike("[a-z]") & c.rlike("[A-Z]") & c.rlike("[0-9]"), F.lit(False))


def otp_ok(c: Column) -> Column:
    """EM3."""
    return F.coalesce(c.rlike(r"^[0-9]{6}\z"), F.lit(False))


def image_type(content: Column) -> Column:
    """BN1: the type by the first bytes: jpeg, png, gif, webp or avif; null for anything else and below 4 bytes."""

    def run(h: Column) -> Column:
        brand = F.substring(h, 17, 8)
        return (
            F.when(F.length(h) < 8, F.lit(None)).when(h.startswith("FFD8FF"), F.lit("image/jpeg")).when(h.startswith("89504E470D0A1A0A"), F.lit("image/png"))
            .when(h.rlike("^47494638(?:37|39)61"), F.lit("image/gif")).when(h.rlike("^52494646.{8}57454250"), F.lit("image/webp"))
            .when((F.substring(h, 9, 8) == "66747970") & brand.isin("61766966", "61766973", "6D696631"), F.lit("image/avif"))
        )

    return let(F.hex(F.substring(content, 1, 12)), run)


def refused_content_type(c: Column) -> Column:
    """BN2: declared types that may hold scripts."""
    return F.coalesce(has_any(F.trim(F.substring_index(F.lower(c), ";", 1)), "svg", "html", "javascript"), F.lit(False))


def image_ok(content: Column, declared: Column, most: int = 10 * 1024 * 1024) -> Column:
    """SRC12, A10: whether stored bytes may be served as an image."""
    return F.coalesce(~refused_content_type(declared) & image_type(content).isNotNull() & (F.octet_length(content) <= most), F.lit(False))
