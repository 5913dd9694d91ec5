"""Programs over the driver's tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ALL
from .plans.env import Env
from .plans.program import Program
from .sources import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def program(df: DataFrame, text: str) -> Program:
    return Env.from_schema(df.schema, ALL).compile(text)


def columns(df: DataFrame, keep: list[str], **texts: str) -> DataFrame:
    """keep and one column for each program."""
    env = Env.from_schema(df.schema, ALL)
    return df.select(*keep, *[env.compile(t).column().alias(n) for n, t in texts.items()])


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


FLAGSHIP = "l_discount >= 0.05 && l_discount <= 0.07 && l_quantity < 24.0 && l_returnflag in ['R', 'A'] && l_shipdate.getFullYear() == 1996"


@query("""SELECT count(*) AS n, round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24 AND l_returnflag IN ('R', 'A') AND year(l_shipdate) = 1996""")
def filter_flagship(spark, d):
    df = table(spark, d, "lineitem")
    return program(df, FLAGSHIP).filter(df).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey * 2 + l_linenumber AS a, l_orderkey // 7 AS b, l_orderkey % 7 AS c, -l_orderkey // 7 AS e, -l_orderkey % 7 AS f FROM lineitem""".replace("-l_orderkey // 7", "-(l_orderkey // 7)"))
def arith_int(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    return columns(df, ["l_orderkey", "l_linenumber"], a="l_orderkey * 2 + l_linenumber", b="l_orderkey / 7", c="l_orderkey % 7", e="-l_orderkey / 7", f="-l_orderkey % 7")


@query("""SELECT count(*) AS n FROM lineitem WHERE CASE WHEN l_linenumber = 1 THEN true ELSE 10 // (l_linenumber - 1) > 3 END""")
def logic_absorb(spark, d):
    df = table(spark, d, "lineitem")
    return program(df, "l_linenumber == 1 || 10 / (l_linenumber - 1) > 3").filter(df).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n FROM lineitem WHERE CASE WHEN l_discount = 0 THEN l_extendedprice > 0 ELSE l_extendedprice / l_discount > 1e6 END""")
def double_div(spark, d):
    df = table(spark, d, "lineitem")
    return program(df, "l_extendedprice / l_discount > 1e6").filter(df).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT size, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size FROM lineitem) GROUP BY size""")
def ternary(spark, d):
    df = table(spark, d, "lineitem")
    return columns(df, [], size="l_quantity > 25.0 ? 'big' : 'small'").groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) - 1 AS m, day(o_orderdate) AS d, day(o_orderdate) - 1 AS dm, dayofweek(o_orderdate)::BIGINT AS w, dayofyear(o_orderdate) - 1 AS yd FROM orders""")
def time_parts(spark, d):
    df = table(spark, d, "orders")
    return columns(df, ["o_orderkey"], y="o_orderdate.getFullYear()", m="o_orderdate.getMonth()", d="o_orderdate.getDate()", dm="o_orderdate.getDayOfMonth()", w="o_orderdate.getDayOfWeek()", yd="o_orderdate.getDayOfYear()")


@query("""SELECT event_id, hour(ts - INTERVAL 5 HOUR) AS h, minute(ts + INTERVAL 330 MINUTE) AS m, second(ts) AS s FROM events""")
def time_zone(spark, d):
    return columns(table(spark, d, "events"), ["event_id"], h="ts.getHours('-05:00')", m="ts.getMinutes('05:30')", s="ts.getSeconds()")


@query("""SELECT o_orderkey, o_orderdate + INTERVAL 36 HOUR AS due, 36::BIGINT AS hours, (epoch(o_orderdate - TIMESTAMP '1995-01-01') // 3600)::BIGINT AS since FROM orders""")
def time_arith(spark, d):
    df = table(spark, d, "orders")
    return columns(df, ["o_orderkey"], due="o_orderdate + duration('36h')", hours="((o_orderdate + duration('36h')) - o_orderdate).getHours()", since="(o_orderdate - timestamp('1995-01-01T00:00:00Z')).getHours()")


@query("""SELECT p_partkey, starts_with(p_brand, 'Brand#1') AS a, contains(p_type, 'E') AS b, strpos(p_name, 'a') - 1 AS c, substr(p_name, 2, 3) AS e, substr(p_name, 1, 1) AS f, length(p_name) AS g FROM part""")
def str_basic(spark, d):
    return columns(table(spark, d, "part"), ["p_partkey"], a="p_brand.startsWith('Brand#1')", b="p_type.contains('E')", c="p_name.indexOf('a')", e="p_name.substring(1, 4)", f="p_name.charAt(0)", g="size(p_name)")


@query("""SELECT p_partkey, array_to_string(string_split(p_name, ' '), '_') AS a, replace(p_brand, '#', '-') AS b, upper(p_name) AS c, reverse(p_name) AS e, len(string_split(p_name, ' ')) AS f, trim('  ' || p_name || ' ') AS g FROM part""")
def str_build(spark, d):
    return columns(table(spark, d, "part"), ["p_partkey"], a="p_name.split(' ').join('_')", b="p_brand.replace('#', '-')", c="p_name.upperAscii()", e="p_name.reverse()", f="p_name.split(' ').size()", g="('  ' + p_name + ' ').trim()")


@query("""SELECT p_partkey, p_brand || '-' || p_size AS a, printf('%.2f', p_retailprice) || '|' || lower(to_hex(p_size)) AS b FROM part""")
def str_format(spark, d):
    return columns(table(spark, d, "part"), ["p_partkey"], a="'%s-%d'.format([p_brand, p_size])", b="'%.2f|%x'.format([p_retailprice, p_size])")


@query("""SELECT doc_id, regexp_matches(text, '(?s)th(e|at)') AS a, len(regexp_extract_all(text, 'the')) AS b, regexp_extract(text, 'tion') AS c FROM documents""")
def regex_match(spark, d):
    return columns(table(spark, d, "documents"), ["doc_id"], a="text.matches('th(e|at)')", b="text.findAll('the').size()", c="text.find('tion')")


@query("""SELECT doc_id, len(regexp_extract_all(text, 'an+')) AS n FROM documents""")
def regex_longest(spark, d):
    """Patterns with repetition go through Arrow for the longest match."""
    return columns(table(spark, d, "documents"), ["doc_id"], n="text.findAll('an+').size()")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, greatest(l_orderkey, l_partkey) AS a, least(l_quantity, 10.0) AS b, round(l_extendedprice, 0) AS c, trunc(l_extendedprice)::DOUBLE AS e,
sign(l_quantity - 25)::DOUBLE AS f, l_orderkey & 255 AS g, (l_orderkey | 7) AS h, xor(l_orderkey, l_partkey) AS i, (l_orderkey << 3) AS j, abs(l_partkey - l_orderkey) AS k, floor(l_extendedprice) AS m, ceil(l_extendedprice) AS o FROM lineitem""")
def math_mix(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    return columns(df, ["l_orderkey", "l_linenumber"], a="math.greatest(l_orderkey, l_partkey)", b="math.least(l_quantity, 10.0)", c="math.round(l_extendedprice)", e="math.trunc(l_extendedprice)", f="math.sign(l_quantity - 25.0)", g="math.bitAnd(l_orderkey, 255)", h="math.bitOr(l_orderkey, 7)", i="math.bitXor(l_orderkey, l_partkey)", j="math.bitShiftLeft(l_orderkey, 3)", k="math.abs(l_partkey - l_orderkey)", m="math.floor(l_extendedprice)", o="math.ceil(l_extendedprice)")


@query("""SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS s, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, len(embedding) AS n FROM embeddings""")
def list_agg(spark, d):
    out = columns(table(spark, d, "embeddings"), ["vec_id"], s="embedding.sum()", lo="embedding.min()", hi="embedding.max()", n="size(embedding)")
    return out.withColumn("s", F.round("s", 6))


@query("""SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS a, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2)), 6) AS b, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS c,
len(list_filter(embedding, lambda x: x < 1)) = len(embedding) AS e, len(list_filter(embedding, lambda x: x > 0.3)) = 1 AS f FROM embeddings""")
def list_macros(spark, d):
    out = columns(table(spark, d, "embeddings"), ["vec_id"], a="embedding.filter(x, x > 0.0).size()", b="embedding.map(x, x * 2.0).sum()", c="embedding.exists(x, x > 0.3)", e="embedding.all(x, x < 1.0)", f="embedding.exists_one(x, x > 0.3)")
    return out.withColumn("b", F.round("b", 6))


@query("""SELECT vec_id, list_sort(embedding)[1]::DOUBLE AS a, list_reverse_sort(embedding)[1]::DOUBLE AS b, embedding[2]::DOUBLE AS c, embedding[1]::DOUBLE AS e, embedding[-1]::DOUBLE AS f,
len(list_distinct(list_transform(embedding, lambda x: x > 0))) AS g, embedding = list_sort(embedding) AS h FROM embeddings""")
def list_sort(spark, d):
    return columns(table(spark, d, "embeddings"), ["vec_id"], a="embedding.sort()[0]", b="embedding.sortBy(x, -x)[0]", c="embedding.slice(1, 3)[0]", e="embedding.first().value()", f="embedding.last().value()", g="embedding.map(x, x > 0.0).distinct().size()", h="embedding.isSorted()")


@query("""SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity > 45) AND NOT bool_and(l_returnflag = 'N'))""")
def nested_exists(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("items"))
    return program(items, "items.exists(x, x.l_quantity > 45.0) && !items.all(x, x.l_returnflag == 'N')").filter(items).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, list_has_any(string_split(text, ' '), ['the', 'and']) AS a, list_has_all(string_split(text, ' '), ['the', 'and']) AS b FROM documents""")
def set_ops(spark, d):
    return columns(table(spark, d, "documents"), ["doc_id"], a="sets.intersects(text.split(' '), ['the', 'and'])", b="sets.contains(text.split(' '), ['the', 'and'])")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity AS a, l_returnflag IN ('R', 'q') AS b, 2 + (l_returnflag <> 'x')::BIGINT AS c, l_orderkey * 10 AS e FROM lineitem""")
def map_ops(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    return columns(df, ["l_orderkey", "l_linenumber"], a="{'q': l_quantity, 'p': l_extendedprice}['q']", b="l_returnflag in {'R': 1, 'q': 2}", c="{'x': 1, 'y': 2}.merge({l_returnflag: 3}).size()", e="{'k': l_orderkey}.transformMap(k, v, v * 10).k")


@query("""SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN user_id END, 0) AS a, coalesce(CASE WHEN event_type = 'click' THEN user_id + 1 END, -1) AS b, false AS c FROM events""")
def optional_ops(spark, d):
    return columns(table(spark, d, "events"), ["event_id"], a="{event_type: user_id}[?'click'].orValue(0)", b="{event_type: user_id}[?'click'].optMap(x, x + 1).orValue(-1)", c="optional.none().hasValue()")


@query("""SELECT count(*) AS n FROM events WHERE json_extract(props, '$.k')::DOUBLE > 50""")
def json_ops(spark, d):
    df = table(spark, d, "events")
    return program(df, "json.unmarshal(props).k > 50").filter(df).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, md5(text) AS a, sha256(text) AS b FROM documents""")
def hash_ops(spark, d):
    return columns(table(spark, d, "documents"), ["doc_id"], a="hash.md5(text)", b="hash.sha256(text)").select("doc_id", F.lower(F.hex("a")).alias("a"), F.lower(F.hex("b")).alias("b"))


@query("""SELECT p_partkey, lower(lpad(to_hex(list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(string_split(p_name, ''), lambda c: ord(c)::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT), 16, '0')) AS h FROM part""")
def fnv_ops(spark, d):
    return columns(table(spark, d, "part"), ["p_partkey"], h="hash.fnv64a(p_name)").withColumn("h", F.lower(F.hex("h")))


@query("""SELECT page_id, regexp_extract(url, '^([^:]*):', 1) AS a, regexp_extract(url, '://([^/?#]*)', 1) AS b, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS c, contains(url, '?') AS e FROM pages""")
def url_ops(spark, d):
    return columns(table(spark, d, "pages"), ["page_id"], a="url(url).getScheme()", b="url(url).getHostname()", c="url(url).getEscapedPath()", e="url(url).getQuery().size() > 0")


@query("""SELECT p_partkey, CASE WHEN p_size < 25 THEN -1 WHEN p_size > 25 THEN 1 WHEN 1 > 0 THEN 1 END::BIGINT AS a, true AS b FROM part""")
def semver_ops(spark, d):
    return columns(table(spark, d, "part"), ["p_partkey"], a="semver(string(p_size) + '.1.0').compareTo(semver('25.0.0'))", b="isSemver(string(p_size) + '.0.1-rc.1')")


@query("""SELECT event_id, (user_id % 256) < 128 AS a, true AS b FROM events""")
def net_ops(spark, d):
    return columns(table(spark, d, "events"), ["event_id"], a="cidr('10.0.0.0/17').containsIP('10.0.' + string(user_id % 256) + '.1')", b="isIP('10.0.' + string(user_id % 256) + '.1')")


@query("""SELECT event_type, regexp_matches(event_type, '^[a-z0-9]([-a-z0-9]{0,61}[a-z0-9])?$') AS ok, count(*) AS n FROM events GROUP BY 1, 2""")
def format_ops(spark, d):
    return columns(table(spark, d, "events"), ["event_type"], ok="!format.dns1123Label().validate(event_type).hasValue()").groupBy("event_type", "ok").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40""")
def residual(spark, d):
    df = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    env = Env.from_schema(df.schema, ALL)
    _, rest = env.partial("l_returnflag == 'R' && l_quantity > 40.0 || l_returnflag == 'X'", {"l_returnflag": "R"})
    return env.compile(rest).filter(df).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, c_acctbal AS a, c_acctbal < 0 AS b, string_split(c_name, '#')[2] AS c, CAST(c_custkey AS VARCHAR) AS e, CAST(c_acctbal AS BIGINT) AS f FROM customer""".replace("CAST(c_acctbal AS BIGINT)", "trunc(c_acctbal)::BIGINT"))
def conversions(spark, d):
    return columns(table(spark, d, "customer"), ["c_custkey"], a="double(string(c_acctbal))", b="bool(string(c_acctbal < 0.0))", c="c_name.split('#')[?1].orValue('')", e="string(c_custkey)", f="int(c_acctbal)").withColumn("c", F.when(F.col("c") == "", None).otherwise(F.col("c")))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_quantity > 30 THEN l_extendedprice ELSE 0 END AS a, l_quantity * 2 + 1 AS b FROM lineitem""")
def bind_and_block(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    return columns(df, ["l_orderkey", "l_linenumber"], a="cel.bind(q, l_quantity > 30.0, q ? l_extendedprice : 0.0)", b="cel.block([l_quantity * 2.0, cel.index(0) + 1.0], cel.index(1))")


@query("""SELECT * FROM (VALUES
('l_discount >= 0.05 && l_discount <= 0.07 && l_quantity < 24.0 && l_returnflag in [''R'', ''A''] && l_shipdate.getFullYear() == 1996', 34::BIGINT, 34::BIGINT, 22::BIGINT, 0::BIGINT, 'bool'),
('[1, 2, 3].exists(x, x == l_orderkey)', 14, 3011, 9, 0, 'bool'), ('l_returnflag.matches(''R|A'')', 31, 31, 3, 0, 'bool')) AS t(program, least, most, nodes, issues, type)""")
def cost_validate(spark, d):
    env = Env.from_schema(table(spark, d, "lineitem").schema, ALL)
    rows = []
    for text in (FLAGSHIP, "[1, 2, 3].exists(x, x == l_orderkey)", "l_returnflag.matches('R|A')"):
        p = env.compile(text)
        rows.append((text, p.cost().least, p.cost().most, p.nodes(), len(p.validate()), p.output_type()))
    return spark.createDataFrame(rows, "program string, least long, most long, nodes long, issues long, type string")
