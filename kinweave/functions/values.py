"""Column functions: missing values, time bins, labels, buckets and seeded hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.spec import MISSING, TIMEBIN_SECONDS


def is_valid(c: Column, tokens=MISSING) -> Column:
    """Not null and, trimmed, none of the missing tokens."""
    return c.isNotNull() & ~F.trim(c.cast("string")).isin(*tokens)


def valid_value(c: Column, tokens=MISSING) -> Column:
    """The untrimmed text of a valid value, else null."""
    return F.when(is_valid(c, tokens), c.cast("string"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, the same under any session time zone."""
    return F.datediff(ts, F.lit("1970-01-01")) * 86400.0 + F.hour(ts) * 3600.0 + F.minute(ts) * 60.0 + F.date_part(F.lit("SECOND"), ts).cast("double")


def parse_time(text: Column) -> Column:
    """A number of seconds or an ISO text as seconds; 0 if it is neither."""
    return F.coalesce(F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double"), epoch_seconds(text.try_cast("timestamp_ntz")), F.lit(0.0))


def time_bin(seconds: Column, width: int = TIMEBIN_SECONDS) -> Column:
    """The bin as text; null for bin 0, which stands for an unknown time."""
    return valid_value(F.floor(seconds / F.lit(float(width))).cast("long").cast("string"))


def seeded_hash(seed, *parts: Column) -> Column:
    """A hexadecimal digest of seed and parts; orders rows at random but reproducibly. The seed may be a column."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", first, *[p.cast("string") for p in parts]))


def hash_number(seed, *parts: Column) -> Column:
    """A number in [0, 2**32) from the digest."""
    return F.conv(F.substring(seeded_hash(seed, *parts), 1, 8), 16, 10).cast("long")


def first_match(rules, otherwise: Column) -> Column:
    """The result of the first rule (condition, result) that holds."""
    out = otherwise
    for condition, result in reversed(rules):
        out = F.when(condition, F.lit(result)).otherwise(out)
    return out


def _has(c: Column, all_of: str) -> Column:
    """All of the texts, joined by +, occur; alternatives are joined by |."""
    any_of = [[F.contains(c, F.lit(x)) for x in option.split("+")] for option in all_of.split("|")]
    out = F.lit(False)
    for option in any_of:
        both = F.lit(True)
        for x in option:
            both = both & x
        out = out | both
    return out


#: Issuer buckets in order of precedence (fixed values).
ISSUERS = (
    ("let's encrypt|letsencrypt", "PublicCA_LetsEncrypt"),
    ("digicert", "PublicCA_DigiCert"),
    ("sectigo|comodo", "PublicCA_Sectigo"),
    ("cloudflare", "PublicCA_Cloudflare"),
    ("globalsign", "PublicCA_GlobalSign"),
    ("amazon+ca", "PublicCA_Amazon"),
    ("google trust|gts", "PublicCA_Google"),
    ("usertrust", "PublicCA_USERTrust"),
    ("entrust", "PublicCA_Entrust"),
    ("godaddy", "PublicCA_GoDaddy"),
    ("isrg", "PublicCA_ISRG"),
    ("self-signed|self signed", "SelfSigned"),
    ("ca|certificate authority|o=", "PublicCA_Other"),
)
#: Cipher buckets by version, in order of precedence (fixed values).
CIPHERS_13 = (("AES+GCM", "TLSv13_AES_GCM"), ("CHACHA20", "TLSv13_CHACHA20"), ("AES+CCM", "TLSv13_AES_CCM"))
CIPHERS_12 = (
    ("ECDHE+GCM", "TLSv12_ECDHE_AES_GCM"),
    ("ECDHE+CHACHA20", "TLSv12_ECDHE_CHACHA20"),
    ("ECDHE+CBC", "TLSv12_ECDHE_CBC_Legacy"),
    ("DHE+GCM", "TLSv12_DHE_AES_GCM"),
    ("RSA+CBC", "TLSv12_RSA_CBC_Legacy"),
    ("RSA+GCM", "TLSv12_RSA_AES_GCM"),
)
#: Upper bounds of certificate validity in days (fixed values).
VALIDITY = ((7, "validity_0_7d"), (30, "validity_8_30d"), (90, "validity_31_90d"), (398, "validity_91_398d"), (825, "validity_399_825d"))


def issuer_bucket(issuer: Column) -> Column:
    text = F.lower(issuer)
    known = first_match([(_has(text, sign), name) for sign, name in ISSUERS], F.lit("Private_or_Unknown"))
    return F.when(issuer.isNull() | issuer.isin("", "-", "(empty)"), F.lit("")).otherwise(known)


def cipher_group(version: Column, cipher: Column) -> Column:
    v = F.regexp_replace(F.upper(F.coalesce(version, F.lit(""))), "[- ]", "")
    c = F.upper(F.coalesce(cipher, F.lit("")))
    within = lambda rules, other: first_match([(_has(c, sign), name) for sign, name in rules], F.lit(other))
    return (
        F.when((v == "") & (c == ""), F.lit(""))
        .when(F.contains(v, F.lit("TLSV13")) | (v == "TLS13"), within(CIPHERS_13, "TLSv13_Other"))
        .when(F.contains(v, F.lit("TLSV12")) | (v == "TLS12"), within(CIPHERS_12, "TLSv12_Other"))
        .when(F.contains(v, F.lit("TLSV1")) | v.isin("TLS10", "TLS11"), F.lit("TLSv1x_Legacy_Deprecated"))
        .when(F.contains(v, F.lit("SSL")), F.lit("SSL_Deprecated"))
        .otherwise(F.lit("Unknown"))
    )


def validity_bucket(begin: Column, end: Column) -> Column:
    a, b = (F.coalesce(x.cast("string").try_cast("double"), F.lit(0.0)) for x in (begin, end))
    days = (b - a) / 86400.0
    by_days = first_match([(days <= limit, name) for limit, name in VALIDITY], F.lit("validity_long_2y_plus"))
    return F.when((a <= 0) | (b <= 0), F.lit("unknown")).when(b < a, F.lit("invalid_range")).otherwise(by_days)


def version_cipher_fingerprint(version: Column, cipher: Column) -> Column:
    return F.md5(F.concat(F.coalesce(version, F.lit("")), F.lit("|"), F.coalesce(cipher, F.lit(""))))


def handshake_fingerprint(version: Column, *lists: Column) -> Column:
    """Digest of a handshake: its version and its lists (ciphers, extensions, curves, point formats).

    Lists are joined by dashes, fields by commas; a null or empty list leaves its field empty.
    """
    joined = [F.concat_ws("-", x.cast("array<string>")) for x in lists]
    return F.md5(F.concat_ws(",", F.coalesce(version.cast("string"), F.lit("")), *joined))


def first_of_list(c: Column) -> Column:
    """The first element of a comma-joined list, trimmed."""
    return F.trim(F.get(F.split(c, ","), F.lit(0)))


def endpoints(ip_a: Column, port_a: Column, ip_b: Column, port_b: Column) -> Column:
    """Both endpoints in an order that does not depend on the direction."""
    a, b = F.struct(ip_a.alias("ip"), port_a.alias("port")), F.struct(ip_b.alias("ip"), port_b.alias("port"))
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


#: Parts of names that suggest a row number (fixed values).
INDEX_NAMES = ("unnamed", "index", "row_id", "rowid", "flow_id", "flowid", "no.", "serial", "seq")


def index_like_names(columns: list[str]) -> list[str]:
    return [c for c in columns if any(sign in c.lower() for sign in INDEX_NAMES)]


def label_by_substring(text: Column, rules, otherwise=None) -> Column:
    """The label of the first (substring, label) that occurs in the lower-case text."""
    low = F.lower(text)
    return first_match([(F.contains(low, F.lit(sign)), label) for sign, label in rules], F.lit(otherwise))


def label_by_longest(text: Column, tokens, otherwise=None) -> Column:
    """The longest token that occurs; ties go to the first in order."""
    ordered = sorted(tokens, key=lambda t: (-len(t), t))
    return label_by_substring(text, [(t.lower(), t) for t in ordered], otherwise)


def label_by_file_name(path: Column, categories, otherwise=None) -> Column:
    """The first category whose name after its first underscore occurs in the file's name."""
    name = F.element_at(F.split(path, "/"), -1)
    return label_by_substring(name, [(c.split("_", 1)[1].lower(), c) for c in categories], otherwise)


def clean_label(c: Column) -> Column:
    """The label trimmed and in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def tuple_text(columns: list[str], candidates) -> Column:
    """A row's tuple as text: the values of those candidates that the table has, three at least."""
    have = [c for c in candidates if c in columns]
    if len(have) < 3:
        raise ValueError(f"fewer than three of {list(candidates)} in {columns}")
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in have])


def folder(path: Column, depth: int = 1) -> Column:
    """The folder that many levels above the file."""
    return F.element_at(F.split(path, "/"), -1 - depth)


def binary_label(c: Column, positive=None, negative=None) -> Column:
    """1 for the positive values, or for all but the negative ones."""
    hit = c.isin(*positive) if positive is not None else ~c.isin(*negative)
    return F.when(hit, 1).otherwise(0)


def family(c: Column, prefixes) -> Column:
    """The family of the first prefix (prefix, family) that fits, else null."""
    return first_match([(c.startswith(p), name) for p, name in prefixes], F.lit(None).cast("string"))


def decode_variant(tag: Column) -> dict[str, Column]:
    """Mode, split seed, edge seed and test size from names like random_s42, edges_e7, cutoff_t0175."""
    number = lambda sign: F.regexp_extract(tag, rf"_{sign}(\d+)", 1).try_cast("long")
    return {"mode": F.regexp_extract(tag, r"^([a-z]+)", 1), "split_seed": number("s"), "edge_seed": number("e"), "test_size": number("t") / F.lit(1000.0)}


def log_count(c: Column) -> Column:
    return F.log1p(F.coalesce(c.cast("double"), F.lit(0.0)))


def safe_name(text: str) -> str:
    return re.sub(r"\W", "_", text)
