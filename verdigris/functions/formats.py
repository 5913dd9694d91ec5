"""Named formats, semantic versions and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.env import Library
from ..plans.types import FORMAT
from .standard import decode_base64, parse_timestamp, wrapped

FORMAT_LIBRARY, SEMVER_LIBRARY, URLS = Library("format"), Library("semver"), Library("urls")

_LABEL = "[a-z0-9]([-a-z0-9]{0,61}[a-z0-9])?"
_LABEL_1035 = "[a-z]([-a-z0-9]{0,61}[a-z0-9])?"
_NAME = "[A-Za-z0-9]([-A-Za-z0-9_.]{0,61}[A-Za-z0-9])?"
#: Schemes, then anything but blanks and controls.
_URI = r"[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20\x7f]*"


def _like(pattern: str, most: int | None = None, trim: str = ""):
    def test(s):
        bare = F.regexp_replace(s, f"[{trim}]+$", "") if trim else s
        out = F.rlike(bare, F.lit(rf"^(?:{pattern})\z"))
        return out if most is None else out & (F.octet_length(bare) <= most)

    return test


_SUBDOMAIN = rf"{_LABEL}(?:\.{_LABEL})*"
#: name: (test, message); the messages are fixed values.
FORMATS = {
    "dns1123Label": (_like(_LABEL), "must be a DNS-1123 label"),
    "dns1123Subdomain": (_like(_SUBDOMAIN, 253), "must be a DNS-1123 subdomain"),
    "dns1035Label": (_like(_LABEL_1035), "must be a DNS-1035 label"),
    "qualifiedName": (lambda s: _like(rf"(?:{_SUBDOMAIN}/)?{_NAME}")(s) & (F.octet_length(F.substring_index(s, "/", 1)) <= 253), "must be a qualified name"),
    "dns1123LabelPrefix": (_like(_LABEL, None, "-"), "must be a DNS-1123 label prefix"),
    "dns1123SubdomainPrefix": (_like(_SUBDOMAIN, 253, ".-"), "must be a DNS-1123 subdomain prefix"),
    "dns1035LabelPrefix": (_like(_LABEL_1035, None, "-"), "must be a DNS-1035 label prefix"),
    "labelValue": (_like(rf"(?:{_NAME})?"), "must be a valid label value"),
    "uri": (_like(rf"/(?!/)(?s:.*)|{_URI}"), "invalid URI"),
    "uuid": (_like("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"), "does not match the UUID format"),
    "byte": (lambda s: F.when(s.isNotNull(), decode_base64(s).isNotNull() & (F.length(s) % 4 == 0)), "invalid base64"),
    "date": (lambda s: F.when(s.isNotNull(), _like("[0-9]{4}-[0-9]{2}-[0-9]{2}")(s) & F.try_to_date(s, "yyyy-MM-dd").isNotNull()), "invalid date"),
    "datetime": (lambda s: F.when(s.isNotNull(), parse_timestamp(s).isNotNull()), "invalid datetime"),
}

add = FORMAT_LIBRARY.add
for _name in FORMATS:
    add(f"format.{_name}() -> cel.Format")(lambda c, name=_name: F.struct(F.lit(name).alias("name")))


@add("format.named(string) -> optional_type(cel.Format)", observes=True)
def _(c, s):
    return F.when(s.isin(*FORMATS), wrapped(F.struct(s.alias("name"))))


@add("@cel.Format.validate(string) -> optional_type(list(string))", observes=True)
def _(c, f, s):
    message = None
    node = c.node.args[0]
    fixed = node.value.name.removeprefix("format.") if node.op == "call" and node.value.name.startswith("format.") and node.value.name != "format.named" else None
    for name, (test, text) in FORMATS.items():
        if fixed in (None, name):
            bad = ~test(s) if fixed else (f["name"] == name) & ~test(s)
            message = F.when(bad, text) if message is None else message.when(bad, text)
    return F.when(message.isNotNull(), wrapped(F.array(message)))


assert FORMAT.name == "cel.Format"

# ---- semantic versions

add = SEMVER_LIBRARY.add
_N = "(0|[1-9][0-9]*)"
_PRE = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
_SEMVER = rf"^{_N}\.{_N}\.{_N}(?:-({_PRE}(?:\.{_PRE})*))?(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?\z"


def _normal(s):
    """Without a leading v, three parts, no leading zeros."""
    bare = F.regexp_replace(s, "^v", "")
    core = F.regexp_extract(bare, r"^[^+-]*", 0)
    rest = F.substring(bare, F.length(core) + 1, F.length(bare))
    parts = F.split(core, r"\.")
    short = (F.size(parts) < 3) & (rest != "")
    padded = F.slice(F.concat(parts, F.array(F.lit("0"), F.lit("0"))), F.lit(1), F.greatest(F.size(parts), F.lit(3)))
    clean = F.array_join(F.transform(padded, lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "")), ".")
    return F.when(short, bare).otherwise(F.concat(clean, rest))


def _parsed(s):
    part = lambda i: F.regexp_extract(s, _SEMVER, i)
    numbers = [part(i).try_cast("bigint") for i in (1, 2, 3)]
    ok = F.rlike(s, F.lit(_SEMVER)) & numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    return F.when(ok, F.struct(*[n.alias(a) for n, a in zip(numbers, ("major", "minor", "patch"), strict=True)], part(4).alias("pre"), part(5).alias("build")))


def _loosely(s, loose):
    return F.when(loose, _normal(s)).when(~loose, s)


add("semver(string) -> cel.Semver")(lambda c, s: _parsed(s))
add("semver(string, bool) -> cel.Semver")(lambda c, s, b: _parsed(_loosely(s, b)))
add("isSemver(string) -> bool")(lambda c, s: F.when(s.isNotNull(), _parsed(s).isNotNull()))
add("isSemver(string, bool) -> bool")(lambda c, s, b: F.when(s.isNotNull() & b.isNotNull(), _parsed(_loosely(s, b)).isNotNull()))
for _name in ("major", "minor", "patch"):
    add(f"@cel.Semver.{_name}() -> int")(lambda c, v, name=_name: v[name])


def _rank(v):
    """A struct that sorts by precedence: a release after its pre-releases, numbers before words, build left out."""
    ids = F.when(v["pre"] == "", F.array().cast("array<string>")).otherwise(F.split(v["pre"], r"\."))
    keys = F.transform(ids, lambda p: F.struct(
        F.rlike(p, F.lit("[^0-9]")).alias("word"),
        F.when(~F.rlike(p, F.lit("[^0-9]")), F.length(p)).otherwise(0).alias("size"),
        p.alias("text"),
    ))
    return F.struct(v["major"].alias("a"), v["minor"].alias("b"), v["patch"].alias("c"), (v["pre"] == "").alias("d"), keys.alias("e"))


def _compared(v, w):
    a, b = _rank(v), _rank(w)
    return F.when(v.isNotNull() & w.isNotNull(), F.when(a < b, -1).when(a > b, 1).otherwise(0).cast("bigint"))


add("@cel.Semver.compareTo(cel.Semver) -> int")(lambda c, v, w: _compared(v, w))
add("@cel.Semver.isGreaterThan(cel.Semver) -> bool")(lambda c, v, w: _compared(v, w) > 0)
add("@cel.Semver.isLessThan(cel.Semver) -> bool")(lambda c, v, w: _compared(v, w) < 0)

# ---- URLs

add = URLS.add


def _url(s):
    return F.when(FORMATS["uri"][0](s), F.struct(s.alias("raw")))


add("url(string) -> cel.URL")(lambda c, s: _url(s))
add("isURL(string) -> bool")(lambda c, s: FORMATS["uri"][0](s))


def _rooted(u):
    return F.startswith(u["raw"], F.lit("/"))


def _authority(u):
    return F.when(_rooted(u), "").otherwise(F.regexp_extract(u["raw"], r"^[^:]*://([^/?#]*)", 1))


def _host_port(u):
    return F.regexp_replace(_authority(u), r"^.*@", "")


def decoded(s):
    """Percent signs followed by two hexadecimal digits, decoded; others stay."""
    safe = F.replace(F.regexp_replace(s, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(safe)


add("@cel.URL.getScheme() -> string")(lambda c, u: F.when(_rooted(u), "").otherwise(F.substring_index(u["raw"], ":", 1)))
add("@cel.URL.getHost() -> string")(lambda c, u: _host_port(u))
add("@cel.URL.getHostname() -> string")(lambda c, u: F.regexp_replace(F.regexp_replace(_host_port(u), r":[0-9]*$", ""), r"^\[(.*)\]$", "$1"))
add("@cel.URL.getPort() -> string")(lambda c, u: F.regexp_extract(_host_port(u), r":([0-9]+)$", 1))


@add("@cel.URL.getEscapedPath() -> string")
def _(c, u):
    path = F.when(_rooted(u), F.regexp_extract(u["raw"], r"^[^?#]*", 0)).otherwise(F.regexp_extract(u["raw"], r"^[^:]*:(?://[^/?#]*)?([^?#]*)", 1))
    plain = decoded(path)
    # everything but what a path may hold is written by its octets
    octets = F.regexp_extract_all(F.hex(plain.cast("binary")), F.lit("(..)"), F.lit(1))
    kept = lambda h: F.decode(F.unhex(h), "UTF-8")
    allowed = r"^(?:2D|2E|5F|7E|3[0-9]|[46][1-9A-F]|[57][0-9A]|21|24|26|27|28|29|2A|2B|2C|3B|3D|3A|40|2F)$"
    return F.when(path == "", "").otherwise(F.array_join(F.transform(octets, lambda h: F.when(F.rlike(h, F.lit(allowed)), kept(h)).otherwise(F.concat(F.lit("%"), h))), ""))


@add("@cel.URL.getQuery() -> map(string, list(string))")
def _(c, u):
    query = decoded(F.regexp_extract(u["raw"], r"^[^?#]*\?([^#]*)", 1))
    spaced = lambda s: F.translate(s, "+", " ")
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(spaced(F.substring_index(p, "=", 1)).alias("k"), spaced(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"^[^=]*=", "")).otherwise("")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]).alias("value"))))
