"""More programs over the driver's tables, so that every function and form is compared with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import ALL
from .plans.env import Env
from .queries import columns, query, table
from .sources.protobuf import Descriptor, Field, decode_messages

@query("""SELECT event_id, event_type = 'click' AS a, true AS b, true AS c, json_extract(props, '$.k') IS NOT NULL AS e, false AS f, event_type = 'click' AND user_id > 20 AS g FROM events""")
def has_ops(spark, d):
    df = table(spark, d, "events")
    env = Env.from_schema(df.schema, ALL).child({"known": "map(string, int)", "least": "int"})
    _, rest = env.partial("has(known.a) && has({event_type: 1}.click) && user_id > least", {"known": {"a": 1}, "least": 20})
    return columns(df, ["event_id"], a="has({event_type: user_id}.click)", b="has({'a': 1}.a) && !has({'a': 1}.b)", c="has([1, 2][1]) && !has([1, 2][5])", e="has(json.unmarshal(props).k)", f="has(json.unmarshal(props).zz)", g=rest)


@query("""SELECT vec_id, len(list_filter(embedding, lambda x, i: NOT (i <= 1000 AND x < 0.3))) = 0 AS a, len(list_filter(embedding, lambda x, i: i > 31 AND x > 0.1)) > 0 AS b, len(list_filter(embedding, lambda x, i: i = 4 OR x > 5)) = 1 AS c,
len(list_filter(embedding, lambda x: x > 0.2)) AS e, coalesce(list_sum(list_transform(list_filter(list_zip(embedding, range(len(embedding))), lambda p: p[1] > 0), lambda p: p[2])), 0)::BIGINT AS f, 3::BIGINT AS g, embedding[2] > 0 AS h,
CASE WHEN vec_id > 5 THEN vec_id * 2 ELSE -1 END AS k, len(list_filter(embedding, lambda x: x > 0.1)) AS m, len(embedding)::BIGINT AS o FROM embeddings""")
def macros_more(spark, d):
    return columns(
        table(spark, d, "embeddings"), ["vec_id"], a="embedding.all(i, x, i < 1000 && x < 0.3)", b="embedding.exists(i, x, i > 30 && x > 0.1)", c="embedding.exists_one(i, x, i == 3 || x > 5.0)", e="embedding.map(x, x > 0.2, x * 2.0).size()",
        f="embedding.transformList(i, x, x > 0.0, i).sum()", g="embedding.transformMapEntry(i, x, i < 3, {string(i): x}).size()", h="embedding.transformMap(i, x, i < 2, x > 0.0)[1]",
        k="optional.of(vec_id).optFlatMap(x, x > 5 ? optional.of(x * 2) : optional.none()).orValue(-1)", m="embedding.map(cel.iterVar(0, 0), cel.iterVar(0, 0) > 0.1).filter(b, b).size()", o="embedding.transformList(i, x, x).size()",
    )


@query("""SELECT o_orderkey, o_custkey <> 85 AS a, o_custkey + 7 AS b, 3 + length(o_orderstatus) AS c, o_orderkey + 1 AS e, o_custkey AS f, 2::BIGINT AS g, 2::BIGINT AS h, true AS i, o_orderkey > 100 AS k, o_custkey + 21 AS m, o_custkey >= 50 AS n, true AS o FROM orders""")
def literal_forms(spark, d):
    return columns(
        table(spark, d, "orders"), ["o_orderkey"], a="o_custkey != 85", b="int(uint(o_custkey) + 7u)", c="size(b'\\xffab' + bytes(o_orderstatus))", e="o_orderkey // a comment\n + 1", f="{'x-y': o_custkey}.`x-y`", g="[o_custkey, ?optional.of(1), ?optional.none()].size()",
        h="{'a': 1, ?'b': optional.of(o_custkey), ?'c': optional.none()}.size()", i="type(o_orderkey) == int && type(o_orderstatus) == string && type(o_totalprice) == double && type([1]) == list && type(type(1)) == type", k="dyn(o_orderkey) > 100",
        m="o_custkey + 0x10 + 5", n="uint(o_custkey) >= 50u", o="r'\\n'.size() == 2 && '''a'b'''.size() == 3 && uint('7') == 7u",
    )


@query("""SELECT p_partkey, base64(encode(p_name)) AS a, p_type AS b, ends_with(p_name, 'widget') AS c, CASE WHEN contains(p_name, 'a') THEN length(p_name) - strpos(reverse(p_name), 'a') ELSE -1 END AS e,
CASE WHEN contains(substr(p_name, 1, 4), 'l') THEN length(substr(p_name, 1, 4)) - strpos(reverse(substr(p_name, 1, 4)), 'l') ELSE -1 END AS f, lower(p_brand) AS g, '"' || p_brand || '"' AS h, strlen(p_name) AS i, '["' || p_brand || '"]' AS k FROM part""")
def text_more(spark, d):
    return columns(
        table(spark, d, "part"), ["p_partkey"], a="base64.encode(bytes(p_name))", b="string(base64.decode(base64.encode(bytes(p_type))))", c="p_name.endsWith('widget')", e="p_name.lastIndexOf('a')", f="p_name.lastIndexOf('l', 3)", g="p_brand.lowerAscii()",
        h="strings.quote(p_brand)", i="bytes(p_name).size()", k="json.marshal([p_brand])",
    )


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, sqrt(l_quantity) AS a, true AS b, true AS c, true AS e, -l_orderkey - 1 AS f, l_orderkey >> 2 AS g, l_quantity > 25 AS h FROM lineitem""")
def math_more(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    return columns(df, ["l_orderkey", "l_linenumber"], a="math.sqrt(l_quantity)", b="math.isNaN(0.0 / (l_quantity - l_quantity))", c="math.isInf(1.0 / (l_quantity - l_quantity))", e="math.isFinite(l_tax)", f="math.bitNot(l_orderkey)", g="math.bitShiftRight(l_orderkey, 2)", h="!math.isNaN(l_quantity) && l_quantity > 25.0")


@query("""SELECT o_orderkey, 3::BIGINT AS a, CASE WHEN o_orderkey = o_custkey THEN 2 ELSE 2 END::BIGINT AS b, o_custkey AS c, o_custkey AS e, o_custkey AS f, 1::BIGINT AS g, (o_custkey % 5) * (o_custkey % 5 - 1) // 2 AS h, 3 * o_custkey AS i, true AS k, greatest(o_custkey, 5) AS m, o_custkey IN (1, 5) AS n FROM orders""")
def list_more(spark, d):
    return columns(
        table(spark, d, "orders"), ["o_orderkey"], a="[[o_orderkey, 1], [o_custkey]].flatten().size()", b="[o_orderkey, o_custkey, o_orderkey].lastIndexOf(o_orderkey)", c="lists.setAtIndex([o_orderkey, 2], 1, o_custkey)[1]", e="lists.insertAtIndex([1, 2], 0, o_custkey)[0]",
        f="lists.removeAtIndex([o_orderkey, o_custkey], 0)[0]", g="[o_orderkey].zip([o_custkey, 1]).size()", h="lists.range(o_custkey % 5).sum()", i="list.range(3).map(x, x * o_custkey).sum()", k="sets.equivalent([o_custkey, 1], [1, o_custkey, 1])", m="[o_custkey, 5].max()", n="sets.intersects([o_custkey], [1, 5])",
    )


@query("""SELECT page_id, 'http' AS a, len(regexp_extract_all(url, '/')) AS b, regexp_replace(regexp_replace(url, '/', '|'), '/', '|') AS c, regexp_replace(url, 'o', '0') AS e FROM pages WHERE url LIKE 'http%'""")
def regex_more(spark, d):
    df = table(spark, d, "pages").filter("url LIKE 'http%'")
    return columns(df, ["page_id"], a="regex.extract(url, 'http')", b="regex.extractAll(url, '/').size()", c="regex.replaceN(url, '/', '|', 2)", e="regex.replace(url, 'o', '0')")


@query("""SELECT event_id, '{"u":' || user_id || '}' AS a, '["' || event_type || '","x"]' AS b, '"' || event_type || '"' AS c, true AS e, event_type || '~1~0' AS f, '{"k":[' || user_id || ',null]}' AS g FROM events""")
def json_out(spark, d):
    return columns(table(spark, d, "events"), ["event_id"], a="json.marshal({'u': user_id})", b="json.marshal([event_type, 'x'])", c="json.marshal(event_type)", e="json.unmarshal(json.marshal({'v': user_id})).v == user_id", f="jsonpatch.escapeKey(event_type + '/~')", g="json.marshal({'k': [dyn(user_id), dyn(null)]})")


_LABEL = "[a-z0-9]([-a-z0-9]{0,61}[a-z0-9])?"


@query(f"""SELECT event_id, regexp_full_match(event_type || '.' || user_id, '{_LABEL}(\\.{_LABEL})*') AS a, regexp_full_match(event_type, '[a-z]([-a-z0-9]{{0,61}}[a-z0-9])?') AS b, regexp_full_match(event_type || '.x', '{_LABEL}(\\.{_LABEL})*') AS c,
false AS e, true AS f, true AS g, true AS h, false AS i, user_id % 40 BETWEEN 10 AND 29 AS k, length(event_type) % 4 = 0 AND regexp_full_match(event_type, '[A-Za-z0-9+/]*') AS m, user_id % 100 BETWEEN 10 AND 59 AS n, true AS o, regexp_full_match(event_type, '{_LABEL}') AS p, true AS q FROM events""")
def format_more(spark, d):
    ok = lambda name, text: f"!format.{name}().validate({text}).hasValue()"
    return columns(
        table(spark, d, "events"), ["event_id"], a=ok("dns1123Subdomain", "event_type + '.' + string(user_id)"), b=ok("dns1035Label", "event_type"), c=ok("dns1123SubdomainPrefix", "event_type + '.x-'"), e=ok("dns1035LabelPrefix", "string(user_id) + '-'"),
        f=ok("qualifiedName", "'k/' + event_type"), g=ok("labelValue", "event_type"), h=ok("uri", "'http://h/' + event_type"), i=ok("uuid", "event_type"), k=ok("date", "'2024-02-' + string(user_id % 40)"), m=ok("byte", "event_type"),
        n=ok("datetime", "'2024-01-01T00:00:' + string(user_id % 100) + 'Z'"), o="format.named('uuid').hasValue() && !format.named('nope').hasValue()", p=ok("dns1123LabelPrefix", "event_type + '-'"), q=ok("uuid", "'00000000-0000-0000-0000-00000000000a'"),
    )


@query("""SELECT event_id, 4::BIGINT AS a, user_id % 256 = 127 AS b, user_id % 256 <> 127 AND user_id % 256 < 224 AS c, user_id % 256 = 254 AS e, user_id % 256 = 0 AS f, user_id % 256 = 0 AS g FROM events""")
def ip_ops(spark, d):
    n = "string(user_id % 256)"
    return columns(table(spark, d, "events"), ["event_id"], a=f"ip('10.0.' + {n} + '.1').family()", b=f"ip({n} + '.0.0.1').isLoopback()", c=f"ip({n} + '.9.9.9').isGlobalUnicast()", e=f"ip('169.' + {n} + '.0.1').isLinkLocalUnicast()", f=f"ip('224.0.' + {n} + '.1').isLinkLocalMulticast()", g=f"ip('0.0.0.' + {n}).isUnspecified()")


@query("""SELECT event_id, user_id % 64 <= 32 AS a, '10.1.0.0/16' AS b, user_id % 33 AS c, user_id % 256 < 128 AS e, '10.0.0.0' AS f, true AS g, 'net.IP' AS h FROM events""")
def cidr_ops(spark, d):
    n = "string(user_id % 256)"
    return columns(table(spark, d, "events"), ["event_id"], a="isCIDR('10.0.0.0/' + string(user_id % 64))", b=f"string(cidr('10.1.' + {n} + '.7/16').masked())", c="cidr('10.0.0.0/' + string(user_id % 33)).prefixLength()", e=f"cidr('10.0.0.0/9').containsCIDR('10.' + {n} + '.0.0/16')", f="string(cidr('10.1.2.3/8').ip())", g=f"ip.isCanonical('10.0.0.' + {n})", h=f"type(ip('10.0.0.' + {n})) == net.IP ? 'net.IP' : ''")


@query("""SELECT p_partkey, p_size::BIGINT AS a, p_partkey % 10 AS b, 3::BIGINT AS c, p_size >= 25 AS e, p_size < 25 AS f, false AS g FROM part""")
def semver_more(spark, d):
    v = "semver(string(p_size) + '.' + string(p_partkey % 10) + '.3')"
    return columns(table(spark, d, "part"), ["p_partkey"], a=f"{v}.major()", b=f"{v}.minor()", c=f"{v}.patch()", e=f"{v}.isGreaterThan(semver('25.0.0'))", f=f"{v}.isLessThan(semver('25.0.0'))", g="isSemver(string(p_size) + '.1')")


@query("""SELECT page_id, true AS a, regexp_extract(url, '://([^/?#]*)', 1) AS b, regexp_extract(regexp_extract(url, '://([^/?#]*)', 1), ':([0-9]+)$', 1) AS c, '8' || (page_id % 10) AS e FROM pages WHERE url LIKE 'http%'""")
def url_more(spark, d):
    df = table(spark, d, "pages").filter("url LIKE 'http%'")
    return columns(df, ["page_id"], a="isURL(url)", b="url(url).getHost()", c="url(url).getPort()", e="url('http://h:8' + string(page_id % 10) + '/p').getPort()")


@query("""SELECT event_id, hour(timezone('America/New_York', timezone('UTC', ts))) AS a, day(timezone('Asia/Kolkata', timezone('UTC', ts))) AS b, (millisecond(ts) % 1000)::BIGINT AS c, minute(timezone('Asia/Kolkata', timezone('UTC', ts))) AS e FROM events""")
def time_names(spark, d):
    return columns(table(spark, d, "events"), ["event_id"], a="ts.getHours('America/New_York')", b="ts.getDate('Asia/Kolkata')", c="ts.getMilliseconds()", e="ts.getMinutes('Asia/Kolkata')")


@query("""SELECT event_id, user_id AS a, user_id % 3 <> 0 AS b, CASE WHEN user_id % 3 = 0 THEN 7 ELSE user_id % 3 END AS c, event_type AS e, user_id > 10 AS f FROM events""")
def optional_more(spark, d):
    return columns(table(spark, d, "events"), ["event_id"], a="optional.of(user_id).value()", b="optional.ofNonZeroValue(user_id % 3).hasValue()", c="optional.ofNonZeroValue(user_id % 3).or(optional.of(7)).value()", e="[event_type].first().orValue('')", f="{'a': {'b': user_id}}.?a.?b.orValue(0) > 10")


@query("""SELECT event_id, user_id + 1 AS a, false AS b, 0::BIGINT AS c, event_type AS e, event_type = 'click' AS f, user_id AS g, true AS h, user_id > 7 AS i, true AS k FROM events""")
def message_ops(spark, d):
    df = table(spark, d, "events").withColumn("row", F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    env = Env.from_schema(df.schema, ALL).message("shop.Event", "kind string, user bigint", explicit_presence=False)
    env.message("shop.Box", "data variant").message("google.protobuf.FieldMask", "paths array<string>")
    programs = {
        "a": "shop.Event{kind: event_type, user: user_id}.user + 1", "b": "has(shop.Event{kind: event_type}.user)", "c": "shop.Event{kind: event_type}.user", "e": "row.kind", "f": "row.kind == 'click' && has(row.user)",
        "g": "google.protobuf.Int64Value{value: user_id}", "h": "proto.hasExt(row, 'kind') && proto.getExt(row, 'user') == user_id && shop.Event{user: 1} == shop.Event{user: 1}",
        "i": "shop.Box{data: user_id}.data > 7", "k": "shop.Box{data: 9007199254740993}.data == '9007199254740993' && shop.Box{data: b'ab'}.data == 'YWI=' && shop.Box{data: google.protobuf.FieldMask{paths: ['a', 'b']}}.data == 'a,b' && shop.Box{data: {'n': [user_id]}}.data.n[0] == user_id",
    }
    return df.select("event_id", *[env.compile(t).column().alias(n) for n, t in programs.items()])


@query("""SELECT event_id, user_id * 2 AS a, user_id * 3 AS b, user_id + 100 AS c, 2::BIGINT AS e, user_id > 50 AS f, true AS g, 'click' AS h FROM events WHERE event_type = 'click'""")
def extension_ops(spark, d):
    df = table(spark, d, "events").filter("event_type = 'click'")
    env = Env.from_schema(df.schema, ALL, container="shop").message("Money", "units bigint").enum("Color", {"RED": 1, "BLUE": 2}).constant("shop.LIMIT", "int", 50)
    env.function("twice(int) -> int", lambda c, x: x * 2).function("+(Money, Money) -> Money", lambda c, x, y: F.struct((x["units"] + y["units"]).alias("units")))
    env.dynamic_function("times", True, lambda types: types[0] if len(types) == 2 else None, lambda c, types, cols, literals: cols[0] * cols[1])
    programs = {
        "a": "twice(user_id)", "b": "user_id.times(3)", "c": "(Money{units: user_id} + Money{units: 100}).units", "e": "Color.BLUE", "f": "user_id > LIMIT", "g": "shop.LIMIT == 50 && event_type in ['click']", "h": "event_type",
    }
    child = env.child({}, container="shop")
    return df.select("event_id", *[child.compile(t).column().alias(n) for n, t in programs.items()])


def _varint(v):
    """Wire bytes of a number below 2**14."""
    octet = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    return F.when(v < 128, octet(v)).otherwise(F.concat(octet((v % 128) + 128), octet(F.floor(v / 128))))


def _part(number: int, body):
    """A field of bytes on the wire."""
    return F.concat(F.lit(bytes([number << 3 | 2])), _varint(F.octet_length(body)), body)


ITEM = Descriptor("shop.Item", (Field("id", 1, "int64"), Field("tags", 2, "string", repeated=True)))
ORDER = Descriptor("shop.Order", (
    Field("kind", 1, "string"), Field("user", 2, "int64"), Field("item", 3, "message", message=ITEM), Field("extra", 4, "message", message="google.protobuf.Value"),
    Field("counts", 5, "int32", repeated=True), Field("packed", 6, "message", message="google.protobuf.Any"), Field("at", 7, "message", message="google.protobuf.Timestamp"), Field("label", 8, "message", message="google.protobuf.StringValue"),
))


@query("""SELECT event_id, event_type AS a, user_id AS b, user_id AS c, 2::BIGINT AS e, event_type AS f, user_id + 7 AS g, user_id AS h, user_id % 60 AS i, event_type AS k, user_id * 2 AS m FROM events WHERE user_id < 16384""")
def wire_decode(spark, d):
    """Messages from wire bytes: a message field in two parts, a value, packed numbers, a packed message, a time, a wrapper."""
    df = table(spark, d, "events").filter("user_id < 16384")
    text, number = F.col("event_type").cast("binary"), F.concat(F.lit(b"\x08"), _varint(F.col("user_id")))
    item = F.concat(number, _part(2, text))
    packed = F.concat(_part(1, F.lit(b"type.googleapis.com/shop.Item")), _part(2, number))
    wire = F.concat(
        _part(1, text), F.lit(b"\x10"), _varint(F.col("user_id")), _part(3, number), _part(3, _part(2, text)), _part(3, _part(2, text)), _part(4, _part(3, text)),
        _part(5, F.concat(_varint(F.col("user_id")), F.lit(b"\x07"))), _part(6, packed), _part(7, number), _part(8, _part(1, text)), F.lit(b"\x78\x01"),
    )
    df = df.withColumn("wire", wire).withColumn("item", item).withColumn("row", decode_messages(F.col("wire"), ORDER, (ITEM,)))
    env = Env.from_schema(df.schema, ALL).descriptor(ITEM)
    programs = {
        "a": "row.kind", "b": "row.user", "c": "row.item.id", "e": "row.item.tags.size()", "f": "row.extra == event_type ? event_type : ''", "g": "row.counts.sum()", "h": "int(row.packed.id)", "i": "row.at.getSeconds()", "k": "row.label",
        "m": "google.protobuf.Any{type_url: 'type.googleapis.com/shop.Item', value: item}.id * 2",
    }
    return df.select("event_id", *[env.compile(t).column().alias(n) for n, t in programs.items()])


@query("""SELECT event_id, user_id AS a, 2::BIGINT AS b, event_type = 'click' AS c, true AS e, user_id AS f, user_id * 1000 AS g, true AS h, user_id > 5 AS i FROM events""")
def well_known(spark, d):
    return columns(
        table(spark, d, "events"), ["event_id"], a="google.protobuf.ListValue{values: [user_id, 2]}[0]", b="google.protobuf.Struct{fields: {'a': user_id, 'b': 1}}.size()", c="google.protobuf.Value{string_value: event_type} == 'click'",
        e="google.protobuf.Value{} == null && google.protobuf.ListValue{}.size() == 0 && google.protobuf.Struct{}.size() == 0", f="int(google.protobuf.Timestamp{seconds: user_id})", g="google.protobuf.Duration{seconds: user_id, nanos: 5000000}.getSeconds() * 1000",
        h="google.protobuf.Any{type_url: 'x', value: b'y'}.type_url == 'x' && google.protobuf.Any{value: 3} == 3", i="google.protobuf.Value{number_value: user_id} > 5",
    )


@query("""SELECT event_id, event_type = 'click' AND user_id > 20 AS a, user_id + 3 AS b, user_id * 10 AS c, user_id + 100 AS e FROM events""")
def services(spark, d):
    """Unknown attributes, prepared arguments, hooks that replace results, types taken out again."""
    df = table(spark, d, "events").withColumn("row", F.struct("event_type", "user_id"))
    env = Env.from_schema(df.schema, ALL).child({"m": "map(string, int)"})
    _, rest = env.partial("m.least < 30 && row.event_type == 'click' && row.user_id > m.least", {"m": {"least": 20}, "row": {"event_type": "click"}}, ["row.*"])
    env.dynamic_function("plus", True, lambda types: types[0] if len(types) == 2 else None, lambda c, types, cols, prepared: cols[0] + prepared, prepare=lambda literals: F.lit(len(literals[1])))
    env.message("Gone", "x bigint").remove_type("Gone")
    hooked = env.compile("user_id * 10 + 0", optimize=False).column(hooks=[lambda text, kind, v: v + 0 if text == "user_id" and kind.endswith("int)") else None])
    return df.select("event_id", env.compile(rest).column().alias("a"), env.compile("user_id.plus('abc')").column().alias("b"), hooked.alias("c"), env.compile("user_id + 0", optimize=False).column(hooks=[lambda text, kind, v: F.lit(100).cast("bigint") if text == "0" else None]).alias("e"))
