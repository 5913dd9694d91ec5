"""IP addresses and networks, as structs of two halves of 64 bits; IPv4 fills the lower 32."""

from __future__ import annotations

import decimal
import ipaddress
import re

from pyspark.sql import functions as F

from ..operators.lower import let
from ..plans.env import Library
from ..plans.types import CIDR, IP, TYPE
from .numbers import signed, unsigned

NETWORK = Library("network", constants={"net.IP": (TYPE, "net.IP"), "net.CIDR": (TYPE, "net.CIDR")})
add = NETWORK.add
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"
_DEC = "decimal(20,0)"


def _struct(family, hi, lo):
    return F.struct(F.lit(family).cast("int").alias("family") if isinstance(family, int) else family.cast("int").alias("family"), hi.cast(_DEC).alias("hi"), lo.cast(_DEC).alias("lo"))


def parse_ip(s):
    return let(s, _parse_ip)


def _known_ip(text: str):
    """(family, high half, low half) of an address; None if the text is none."""
    if re.fullmatch(_V4[1:-2], text):
        return 4, 0, int(ipaddress.IPv4Address(text))
    try:
        number = int(ipaddress.IPv6Address(text)) if re.fullmatch("[0-9a-fA-F:]+", text) else None
    except ValueError:
        number = None
    return None if number is None else (6, number >> 64, number & (1 << 64) - 1)


def _known_cidr(text: str):
    """(family, high half, low half, prefix) of a network, masked; None if the text is none."""
    m = re.fullmatch(r"([^/]+)/(0|[1-9][0-9]{0,2})", text)
    ip = m and _known_ip(m[1])
    if not ip or int(m[2]) > (32 if ip[0] == 4 else 128):
        return None
    prefix, width = int(m[2]), 32 if ip[0] == 4 else 128
    whole = (ip[1] << 64 | ip[2]) >> width - prefix << width - prefix
    return ip[0], whole >> 64, whole & (1 << 64) - 1, prefix


def _or_known(known, parse, names):
    """A builder that works out a literal argument on the driver."""

    def build(c, s):
        text = c.literal(0)
        if not isinstance(text, str):
            return parse(s)
        found = known(text)
        kinds = {"family": "int", "hi": _DEC, "lo": _DEC, "prefix": "int"}
        if found is None:
            return F.lit(None).cast("struct<" + ",".join(f"{n}:{kinds[n]}" for n in names) + ">")
        return F.struct(*[F.lit(decimal.Decimal(v) if kinds[n] == _DEC else v).cast(kinds[n]).alias(n) for n, v in zip(names, found, strict=True)])

    return build


def _parse_ip(s):
    v4 = let(F.split(s, r"\."), lambda parts: sum((F.get(parts, i).try_cast("bigint") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("bigint")))
    packed = F.contains(s, F.lit("::"))
    left = F.substring_index(s, "::", 1)
    right = F.when(packed, F.substring(s, F.length(left) + 3, F.length(s))).otherwise("")
    groups = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))
    l, r = groups(left), groups(right)
    n = F.size(l) + F.size(r)
    good = F.when(packed, n <= 7).otherwise(n == 8)
    return F.when(F.rlike(s, F.lit(_V4)), _struct(4, F.lit(0), v4)).otherwise(let(F.concat(l, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), r), lambda whole: _parse_groups(s, whole, good)))


def _parse_groups(s, whole, good):
    ok = F.rlike(s, F.lit(r"^[0-9a-fA-F:]+\z")) & good & F.forall(whole, lambda g: F.rlike(g, F.lit(r"^[0-9a-fA-F]{1,4}\z")))
    half = lambda at: F.conv(F.array_join(F.transform(F.slice(whole, F.lit(at), F.lit(4)), lambda g: F.lpad(g, 4, "0")), ""), 16, 10)
    return F.when(ok, _struct(6, half(1), half(5)))


def _shifted(x, n):
    """An unsigned half shifted right by n bits, as bigint; 64 and more leave nothing."""
    return F.when(n >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", signed(x), n.cast("int")))


def _width(v):
    return F.when(v["family"] == 4, 32).otherwise(128)


def _same_network(a, b, prefix):
    """Whether two addresses of one family agree in their first bits."""
    v4 = _shifted(a["lo"], 32 - prefix) == _shifted(b["lo"], 32 - prefix)
    high = _shifted(a["hi"], F.greatest(F.lit(0), 64 - prefix)) == _shifted(b["hi"], F.greatest(F.lit(0), 64 - prefix))
    low = _shifted(a["lo"], F.greatest(F.lit(0), 128 - prefix)) == _shifted(b["lo"], F.greatest(F.lit(0), 128 - prefix))
    return F.when(a["family"] == 4, v4).otherwise(high & low)


def _kept(x, n):
    """A half with its last n bits cleared."""
    bits = signed(x)
    return F.when(n >= 64, F.lit(0).cast(_DEC)).otherwise(unsigned(F.call_function("shiftleft", F.call_function("shiftrightunsigned", bits, F.least(n, F.lit(63)).cast("int")), F.least(n, F.lit(63)).cast("int"))))


def parse_cidr(s):
    return let(s, lambda t: let(parse_ip(F.substring_index(t, "/", 1)), lambda ip: _parse_cidr(t, ip)))


def _parse_cidr(s, ip):
    prefix = F.when(F.rlike(s, F.lit(r"^[^/]+/(0|[1-9][0-9]{0,2})\z")), F.regexp_extract(s, r"/([0-9]+)\z", 1).try_cast("int"))
    lo = F.when(ip["family"] == 4, _kept(ip["lo"], 32 - prefix)).otherwise(_kept(ip["lo"], F.greatest(F.lit(0), 128 - prefix)))
    hi = F.when(ip["family"] == 4, F.lit(0).cast(_DEC)).otherwise(_kept(ip["hi"], F.greatest(F.lit(0), 64 - prefix)))
    return F.when(ip.isNotNull() & (prefix <= _width(ip)), F.struct(ip["family"].alias("family"), hi.alias("hi"), lo.alias("lo"), prefix.alias("prefix")))


def ip_text(v):
    return let(v, _ip_text)


def _ip_text(v):
    lo = signed(v["lo"])
    byte = lambda n: F.call_function("shiftrightunsigned", lo, F.lit(n)).bitwiseAND(F.lit(255).cast("bigint")).cast("string")
    v4 = F.concat_ws(".", *[byte(n) for n in (24, 16, 8, 0)])
    hexed = F.concat(*[F.lpad(F.hex(signed(v[h])), 16, "0") for h in ("hi", "lo")])
    groups = F.transform(F.regexp_extract_all(hexed, F.lit("(....)"), F.lit(1)), lambda g: F.lower(F.regexp_replace(g, "^0{1,3}", "")))
    return F.when(v["family"] == 4, v4).when(v["family"] == 6, let(F.array_join(groups, ":"), _shortened))


def _shortened(text):
    short = text
    for n in range(2, 9):  # the longest run of zeros, the first of several, is written as ::
        run = rf"(^|:)0(?::0){{{n - 1}}}(:|$)"
        at = F.regexp_substr(text, F.lit(run))
        begin = F.regexp_instr(text, F.lit(run))
        short = F.when(begin > 0, F.concat(F.substring(text, F.lit(1), begin - 1), F.lit("::"), F.substring(text, begin + F.length(at), F.length(text)))).otherwise(short)
    return short


def cidr_text(v):
    return let(v, lambda w: F.concat(ip_text(w), F.lit("/"), w["prefix"].cast("string")))


add("ip(string) -> net.IP")(_or_known(_known_ip, parse_ip, ("family", "hi", "lo")))
add("cidr(string) -> net.CIDR")(_or_known(_known_cidr, parse_cidr, ("family", "hi", "lo", "prefix")))
add("isIP(string) -> bool")(lambda c, s: F.when(s.isNotNull(), parse_ip(s).isNotNull()))
add("isIP(net.IP) -> bool")(lambda c, v: F.when(v.isNotNull(), True))
add("isCIDR(string) -> bool")(lambda c, s: F.when(s.isNotNull(), parse_cidr(s).isNotNull()))
add("isCIDR(net.CIDR) -> bool")(lambda c, v: F.when(v.isNotNull(), True))
add("ip.isCanonical(string) -> bool")(lambda c, s: ip_text(parse_ip(s)) == s)
add("string(net.IP) -> string")(lambda c, v: ip_text(v))
add("string(net.CIDR) -> string")(lambda c, v: cidr_text(v))
add("@net.IP.family() -> int")(lambda c, v: v["family"].cast("bigint"))


def _test(name: str, v4, v6) -> None:
    add(f"@net.IP.{name}() -> bool")(lambda c, v: let(v, lambda w: F.when(w["family"] == 4, v4(w["lo"])).when(w["family"] == 6, v6(w["hi"], w["lo"]))))


def _top(x, n):
    """The first n bits of a half."""
    return F.call_function("shiftrightunsigned", signed(x), F.lit(64 - n))


_unspecified = (lambda lo: lo == 0, lambda hi, lo: (hi == 0) & (lo == 0))
_loopback = (lambda lo: F.floor(lo / (1 << 24)) == 127, lambda hi, lo: (hi == 0) & (lo == 1))
_multicast = (lambda lo: F.floor(lo / (1 << 8)) == 0xE00000, lambda hi, lo: _top(hi, 16).bitwiseAND(F.lit(0xFF0F).cast("bigint")) == 0xFF02)
_link_local = (lambda lo: F.floor(lo / (1 << 16)) == 0xA9FE, lambda hi, lo: _top(hi, 10) == 0x3FA)
for _name, _pair in (("isUnspecified", _unspecified), ("isLoopback", _loopback), ("isLinkLocalMulticast", _multicast), ("isLinkLocalUnicast", _link_local)):
    _test(_name, *_pair)
_special = (_unspecified, _loopback, _multicast, _link_local)
_test(
    "isGlobalUnicast",
    lambda lo: ~(_special[0][0](lo) | _special[1][0](lo) | _special[2][0](lo) | _special[3][0](lo)) & (F.floor(lo / (1 << 24)) < 224),
    lambda hi, lo: ~(_special[0][1](hi, lo) | _special[1][1](hi, lo) | _special[2][1](hi, lo) | _special[3][1](hi, lo)) & (_top(hi, 8) != 0xFF),
)


def _contains_ip(net, ip):
    return let(net, lambda a: let(ip, lambda b: _holds_ip(a, b)))


def _holds_ip(net, ip):
    # an IPv4 network takes IPv6 addresses that stand for IPv4 ones
    mapped = (net["family"] == 4) & (ip["family"] == 6) & (ip["hi"] == 0) & (F.floor(ip["lo"] / (1 << 32)) == 0xFFFF)
    four = _struct(4, F.lit(0), F.pmod(ip["lo"], F.lit(1 << 32)))
    return F.when(net.isNotNull() & ip.isNotNull(), F.when(net["family"] == ip["family"], _same_network(net, ip, net["prefix"])).when(mapped, _same_network(net, four, net["prefix"])).otherwise(False))


def _contains_cidr(net, other):
    return let(net, lambda a: let(other, lambda b: _holds_cidr(a, b)))


def _holds_cidr(net, other):
    return F.when(net.isNotNull() & other.isNotNull(), (net["family"] == other["family"]) & (other["prefix"] >= net["prefix"]) & _same_network(net, other, net["prefix"]))


add("@net.CIDR.containsIP(net.IP) -> bool")(lambda c, v, ip: _contains_ip(v, ip))
add("@net.CIDR.containsIP(string) -> bool")(lambda c, v, s: _contains_ip(v, parse_ip(s)))
add("@net.CIDR.containsCIDR(net.CIDR) -> bool")(lambda c, v, w: _contains_cidr(v, w))
add("@net.CIDR.containsCIDR(string) -> bool")(lambda c, v, s: _contains_cidr(v, parse_cidr(s)))
add("@net.CIDR.ip() -> net.IP")(lambda c, v: let(v, lambda w: F.when(w.isNotNull(), _struct(w["family"], w["hi"], w["lo"]))))
add("@net.CIDR.masked() -> net.CIDR")(lambda c, v: v)
add("@net.CIDR.prefixLength() -> int")(lambda c, v: v["prefix"].cast("bigint"))
assert IP.name == "net.IP" and CIDR.name == "net.CIDR"
