"""Store, filters, sorts and scalar functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import overlay
from shelfmark.functions.digest import entry_digest
from shelfmark.functions.ids import (
    id_compare,
    id_literal,
    id_struct,
    majority,
    page_end,
    round2,
)
from shelfmark.functions.terms import STOP_WORDS, terms
from shelfmark.operators import predicates as p
from shelfmark.operators.peers import sort_peers_natural, with_overlay
from shelfmark.operators.replicas import digest_audit
from shelfmark.plans import fixtures as fx
from shelfmark.plans.registry import Query
from shelfmark.schema import ID, Pattern
from shelfmark.session import durable, work_dir
from shelfmark.sources import catalog, imports

Spark = SparkSession
OUT = ["doc_id", *ID, "file_name"]
OUT_SQL = "doc_id, epoch_id, leader_id, entry_id, file_name"
INGEST = datetime(2024, 6, 1)


def terms_sql(column: str) -> str:
    listed = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return (
        f"list_filter(string_split_regex(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+'), "
        f"lambda t: t <> '' AND t NOT IN ({listed}))"
    )


def any_contains_sql(column: str, tokens: list[str]) -> str:
    tests = " OR ".join(f"contains(t, '{t}')" for t in tokens)
    return f"len(list_filter({terms_sql(column)}, lambda t: {tests})) > 0"


def any_equals_sql(column: str, tokens: list[str]) -> str:
    return f"list_has_any({terms_sql(column)}, [{', '.join(repr(t) for t in tokens)}])"


# -- store --------------------------------------------------------------------------------


def _with_holes(spark: Spark, d: str) -> DataFrame:
    rows = fx.entries(spark, d)
    for step, name in ((3, "url"), (5, "file_name"), (7, "language"), (11, "file_size"), (13, "category")):
        rows = rows.withColumn(name, F.when(F.col("doc_id") % step != 0, F.col(name)))
    rows = rows.withColumn("uploaded", F.when(F.col("doc_id") % 17 != 0, F.col("uploaded")))
    return rows.withColumn("leader_key", F.when(F.col("doc_id") % 2 == 0, F.col("hash")))


HOLES_SQL = """holes AS (SELECT doc_id, epoch_id, leader_id, entry_id,
CASE WHEN doc_id % 3 <> 0 THEN url END AS url, CASE WHEN doc_id % 5 <> 0 THEN file_name END AS file_name,
CASE WHEN doc_id % 7 <> 0 THEN language END AS language,
CASE WHEN doc_id % 11 <> 0 THEN file_size END AS file_size,
CASE WHEN doc_id % 13 <> 0 THEN category END AS category,
CASE WHEN doc_id % 17 <> 0 THEN uploaded END AS uploaded,
CASE WHEN doc_id % 2 = 0 THEN hash END AS leader_key FROM entries)"""


def entries_scan(spark: Spark, d: str) -> DataFrame:
    kept = ["doc_id", *ID, "url", "file_name", "file_size", "language", "category", "leader_key"]
    return catalog.fill_entries(_with_holes(spark, d)).select(*kept)


def entries_normalize(spark: Spark, d: str) -> DataFrame:
    rows = catalog.normalize_entries(_with_holes(spark, d), INGEST)
    return rows.select("doc_id", "language", "uploaded", "leader_key")


def _stored(spark: Spark, d: str) -> str:
    path = work_dir(spark, "store")
    rows = fx.entries(spark, d).withColumn("leader_key", F.lit("")).drop("doc_id", "shard_id")
    catalog.append_entries(rows, path)
    return path


STORED_SQL = "epoch_id, leader_id, entry_id, url, file_size, uploaded, category, hash"


def _stored_columns(df: DataFrame) -> DataFrame:
    return df.select(*ID, "url", "file_size", "uploaded", "category", "hash")


def entries_append(spark: Spark, d: str) -> DataFrame:
    return _stored_columns(catalog.read_entries(spark, _stored(spark, d), complete=True))


def entries_delete_where(spark: Spark, d: str) -> DataFrame:
    path = _stored(spark, d)
    gone = (
        F.col("category") == "Music",
        (F.col("category") != "Books") & (F.col("file_size") < 300),
        (F.col("category") == "Video") & (F.col("entry_id") == 0),
    )
    catalog.delete_entries(spark, path, *gone)
    return _stored_columns(catalog.read_entries(spark, path))


def entries_truncate(spark: Spark, d: str) -> DataFrame:
    """Entries per category before, and entries after."""
    path = _stored(spark, d)
    before = durable(catalog.read_entries(spark, path).groupBy("category").agg(F.count(F.lit(1)).alias("before")))
    catalog.truncate(spark, path)
    after = catalog.read_entries(spark, path).agg(F.count(F.lit(1))).scalar()
    return before.withColumn("after", after)


def torrent_xml_ingest(spark: Spark, d: str) -> DataFrame:
    path = work_dir(spark, "xml")
    name, key = F.col("p_name"), F.col("p_partkey").cast("string")
    record = F.concat(
        F.lit("<torrent>\n<title>"), name, F.lit("</title>\n<magnet>magnet:"), key,
        F.lit("</magnet>\n</torrent>"),
    )
    fx.table(spark, d, "part").select(record.alias("value")).write.text(path)
    good, _ = imports.read_torrents(spark, path)
    return good.select("file_name", "url", "category", "file_size")


# -- filters ------------------------------------------------------------------------------


def _on_entries(make):
    return lambda spark, d: make(fx.entries(spark, d)).select(*OUT)


def _on_parts(make):
    return lambda spark, d: make(fx.part_entries(spark, d))


def _entry_filter(make, condition: str) -> Query:
    return Query(_on_entries(make), fx.sql("entries", f"SELECT {OUT_SQL} FROM entries WHERE {condition}"))


def _part_filter(make, condition: str) -> Query:
    return Query(_on_parts(make), fx.sql("part_entries", f"SELECT * FROM part_entries WHERE {condition}"))


DATES = (datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 9, 30))
WHOLE = Pattern(
    file_name="ing OU", min_size=200, max_size=9000, min_ts=datetime(2024, 1, 1, 0, 20),
    language="en", category="Video", description="ther inea is",
)

LOW, HIGH = (1, 100, 5), (6, 101, 30)
BOX_SQL = "epoch_id BETWEEN 1 AND 6 AND leader_id BETWEEN 100 AND 101 AND entry_id BETWEEN 5 AND 30"
TUPLE = "(epoch_id, leader_id, entry_id)"
ORDER = "ORDER BY epoch_id, leader_id, entry_id"


def _wrap_ids(df: DataFrame) -> DataFrame:
    """Ids on a circle: the upper half of the catalog sits below zero, as after a wrap."""
    ids = F.col("id")
    wrapped = (ids - 700) + (p.MIN_LONG + 1)
    return df.withColumn("id", F.when(ids < 700, ids + (p.MAX_LONG - 700)).otherwise(wrapped))


WRAP_SQL = """wrapped AS (SELECT CASE WHEN id < 700 THEN id + 9223372036854775107 ELSE id - 9223372036854775807 - 700 END AS id,
file_name FROM part_entries)"""
WRAP_BOTTOM = p.MAX_LONG - 700
WRAP_TOP = p.MIN_LONG + 1300


def limit_by_unit_size(spark: Spark, d: str) -> DataFrame:
    sizes = fx.units(spark, d).withColumn(
        "num_entries", F.col("num_entries") - F.col("epoch_id") * 7
    )
    return p.limit_by_unit_size(fx.entries(spark, d), sizes).select(*OUT)


# -- scalars ------------------------------------------------------------------------------


def _peer_overlay(spark: Spark, d: str) -> DataFrame:
    return with_overlay(fx.peers(spark, d))


def _overlay_encode(spark: Spark, d: str) -> DataFrame:
    wild = fx.peers(spark, d).withColumn("partition_id", F.col("partition_id") * F.col("age") * 20)
    return with_overlay(wild).select("node_id", "overlay_id")


def _overlay_decode(spark: Spark, d: str) -> DataFrame:
    x = F.col("overlay_id")
    return _peer_overlay(spark, d).select(
        "node_id",
        overlay.overlay_type(x).alias("kind"),
        overlay.overlay_depth(x).alias("depth"),
        overlay.overlay_partition(x).alias("partition_id"),
        overlay.overlay_category(x).alias("category_id"),
    )


def _shard_bits(make):
    """A bit function of (node, partition, depth), over customers at depths 0 to 9."""

    def run(spark: Spark, d: str) -> DataFrame:
        rows = fx.peers(spark, d).withColumn("depth", (F.col("node_id") % 10).cast("int"))
        rows = rows.withColumn("partition_id", F.col("num_entries") % 1024)
        result: Column = make(F.col("node_id"), F.col("partition_id"), F.col("depth"))
        return rows.select("node_id", result.alias("result"))

    return run


def _bits_sql(expression: str) -> str:
    return fx.sql(
        "peers",
        f"SELECT node_id, {expression} AS result FROM bits",
        "bits AS (SELECT node_id, CAST(node_id % 10 AS INT) AS depth, num_entries % 1024 AS partition_id FROM peers)",
    )


def _is_extension(spark: Spark, d: str) -> DataFrame:
    rows = _peer_overlay(spark, d)
    mine = overlay.overlay_encode(F.lit(1), F.lit(1), F.col("node_id") % 2, F.col("category_id"))
    result = overlay.is_extension(F.col("overlay_id"), mine, F.col("node_id") + F.col("age"))
    return rows.select("node_id", result.alias("result"))


PACK = "((CASE depth WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END)::BIGINT * 1073741824 + depth * 67108864 + partition_id * 65536 + category_id)"
# The 32-bit value of a packed id whose top bit may be set.
PACK32 = f"CAST(CASE WHEN {PACK} >= 2147483648 THEN {PACK} - 4294967296 ELSE {PACK} END AS INTEGER)"


def _entry_digest(spark: Spark, d: str) -> DataFrame:
    return fx.entries(spark, d).select("doc_id", entry_digest("doc_id").alias("digest"))


DIGEST_SQL = """sha1(concat_ws(chr(1), CAST(doc_id AS VARCHAR), CAST(file_size AS VARCHAR),
CAST(epoch_ms(uploaded) AS VARCHAR), category, url, file_name, language, description))"""


def _digest_audit(spark: Spark, d: str) -> DataFrame:
    good = entry_digest("doc_id")
    rows = fx.entries(spark, d).withColumn("hash", F.when(F.col("file_size") % 9 != 0, good).otherwise(F.col("hash")))
    return digest_audit(rows, good).select("doc_id", "expected")


def _id_compare(spark: Spark, d: str) -> DataFrame:
    return fx.entries(spark, d).select(
        "doc_id", id_compare(id_struct(), id_literal(3, 101, 20)).alias("result")
    )


def _sorted_parts(spark: Spark, d: str) -> DataFrame:
    return p.topn_sorted(fx.part_entries(spark, d), "file_size", 50, "id")


def _tokenize(spark: Spark, d: str) -> DataFrame:
    return fx.entries(spark, d).select(
        "doc_id",
        F.concat_ws(" ", terms(F.col("file_name"))).alias("file_terms"),
        F.md5(F.concat_ws(" ", terms(F.col("description")))).alias("description_terms"),
    )


QUERIES: dict[str, Query] = {
    "entries_scan": Query(
        entries_scan,
        fx.sql(
            "entries",
            """SELECT doc_id, epoch_id, leader_id, entry_id, coalesce(url, '') AS url,
coalesce(file_name, '') AS file_name, coalesce(file_size, 0) AS file_size, coalesce(language, '') AS language,
coalesce(category, 'Default') AS category, coalesce(leader_key, '') AS leader_key FROM holes""",
            HOLES_SQL,
        ),
    ),
    "entries_normalize": Query(
        entries_normalize,
        fx.sql(
            "entries",
            """SELECT doc_id, coalesce(language, 'english') AS language,
coalesce(uploaded, TIMESTAMP '2024-06-01 00:00:00') AS uploaded, coalesce(leader_key, '') AS leader_key FROM holes""",
            HOLES_SQL,
        ),
    ),
    "entries_append": Query(entries_append, fx.sql("entries", f"SELECT {STORED_SQL} FROM entries")),
    "entries_delete_where": Query(
        entries_delete_where,
        fx.sql(
            "entries",
            f"""SELECT {STORED_SQL} FROM entries WHERE NOT (category = 'Music' OR category <> 'Books' AND file_size < 300
OR category = 'Video' AND entry_id = 0)""",
        ),
    ),
    "entries_truncate": Query(
        entries_truncate,
        fx.sql("entries", "SELECT category, count(*) AS before, CAST(0 AS BIGINT) AS after FROM entries GROUP BY category"),
    ),
    "torrent_xml_ingest": Query(
        torrent_xml_ingest,
        "SELECT p_name AS file_name, concat('magnet:', CAST(p_partkey AS VARCHAR)) AS url, "
        "'Books' AS category, CAST(0 AS BIGINT) AS file_size FROM part",
    ),
    "pages_ingest": Query(
        lambda spark, d: imports.pages_to_entries(fx.table(spark, d, "pages")).select(
            "id", "url", "file_name", "category"
        ),
        "SELECT page_id AS id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS file_name, "
        "'Books' AS category FROM pages",
    ),
    "tokenize_terms": Query(
        _tokenize,
        fx.sql(
            "entries",
            f"""SELECT doc_id, array_to_string({terms_sql('file_name')}, ' ') AS file_terms,
md5(array_to_string({terms_sql('description')}, ' ')) AS description_terms FROM entries""",
        ),
    ),
    "filter_filename_any": _part_filter(
        lambda df: df.filter(p.p_file_name("Wid  ri")), any_contains_sql("file_name", ["wid", "ri"])
    ),
    "filter_filename_wildcard": _entry_filter(
        lambda df: df.filter(p.p_file_name("i?gs th*on?r o-n")),
        f"len(list_filter({terms_sql('file_name')}, lambda t: regexp_matches(t, 'i.gs') OR regexp_matches(t, 'th.*on.r'))) > 0",
    ),
    "filter_size_range": Query(
        lambda spark, d: (
            fx.part_entries(spark, d)
            .filter(p.p_size(10, 20))
            .withColumn("rule", F.lit("closed"))
            .unionByName(
                fx.part_entries(spark, d).filter(p.p_size(40, 0)).withColumn("rule", F.lit("open"))
            )
        ),
        fx.sql(
            "part_entries",
            """SELECT *, 'closed' AS rule FROM part_entries WHERE file_size BETWEEN 10 AND 20
UNION ALL SELECT *, 'open' AS rule FROM part_entries WHERE file_size >= 40""",
        ),
    ),
    "filter_date_range": _entry_filter(
        lambda df: df.filter(p.p_uploaded(*DATES)),
        "uploaded BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-01 09:30:00'",
    ),
    "filter_language": _entry_filter(lambda df: df.filter(p.p_language("fr")), "language = 'fr'"),
    "filter_category": _entry_filter(lambda df: df.filter(p.p_category("Music")), "category = 'Music'"),
    "filter_description_any": _entry_filter(
        lambda df: df.filter(p.p_description("ther Inea")), any_equals_sql("description", ["ther", "Inea"])
    ),
    "filter_pattern": _entry_filter(
        lambda df: p.match(df, WHOLE),
        any_contains_sql("file_name", ["ing", "ou"])
        + " AND file_size BETWEEN 200 AND 9000 AND uploaded >= TIMESTAMP '2024-01-01 00:20:00'"
        + " AND language = 'en' AND category = 'Video' AND "
        + any_equals_sql("description", ["ther", "inea", "is"]),
    ),
    "filter_id_range": Query(
        _on_parts(lambda df: p.find_id_range(df, 50, 1500, 500)),
        fx.sql("part_entries", "SELECT * FROM part_entries WHERE id BETWEEN 50 AND 1500 ORDER BY id LIMIT 500"),
    ),
    "filter_id_box": _entry_filter(
        lambda df: p.find_entry_box(df, LOW, HIGH, 100), f"{BOX_SQL} {ORDER} LIMIT 100"
    ),
    "filter_id_box_lexicographic": _entry_filter(
        lambda df: p.find_entry_box(df, LOW, HIGH, 100_000, lexicographic=True),
        f"epoch_id * 1000000 + leader_id * 1000 + entry_id BETWEEN 1100005 AND 6101030 {ORDER} LIMIT 100000",
    ),
    "filter_id_box_open": _entry_filter(
        lambda df: p.find_entry_box_from(df, LOW, 200),
        f"epoch_id >= 1 AND leader_id >= 100 AND entry_id >= 5 {ORDER} LIMIT 200",
    ),
    "lookup_entry": _entry_filter(
        lambda df: p.find_entry(df, (1, 101, 7)), "epoch_id = 1 AND leader_id = 101 AND entry_id = 7 LIMIT 1"
    ),
    "unit_suffix": Query(
        # Any rows up to the limit will do, so more are asked for than there are.
        lambda spark, d: p.unit_suffix(fx.entries(spark, d), (1, 100, 20), 100).select(*ID, "hash"),
        fx.sql(
            "entries",
            "SELECT epoch_id, leader_id, entry_id, hash FROM entries WHERE epoch_id = 1 AND leader_id = 100 AND entry_id >= 20",
        ),
    ),
    "unit_suffix_sorted": _entry_filter(
        lambda df: p.unit_suffix_sorted(df, (1, 100, 20), 25),
        f"epoch_id = 1 AND leader_id = 100 AND entry_id >= 20 {ORDER} LIMIT 25",
    ),
    "filter_unit": _entry_filter(
        lambda df: p.in_unit(df, 1, 101), "epoch_id = 1 AND leader_id = 101"
    ),
    "trim_ids_high": _entry_filter(
        lambda df: p.trim_high(df, (1, 101, 7), including=True), f"{TUPLE} < (1, 101, 7)"
    ),
    "trim_ids_low": _entry_filter(
        lambda df: p.trim_low(df, (1, 101, 7)), f"{TUPLE} >= (1, 101, 7)"
    ),
    "delete_wrap_low": Query(
        lambda spark, d: p.delete_low_wrap(
            _wrap_ids(fx.part_entries(spark, d)), p.MIN_LONG + 500, WRAP_BOTTOM, WRAP_TOP
        ).select("id", "file_name"),
        fx.sql(
            "part_entries",
            f"""SELECT id, file_name FROM wrapped WHERE NOT (id BETWEEN {WRAP_BOTTOM} AND 9223372036854775806
OR id BETWEEN -9223372036854775807 AND -9223372036854775807 - 1 + 500)""",
            WRAP_SQL,
        ),
    ),
    "delete_wrap_high": Query(
        lambda spark, d: p.delete_high_wrap(
            _wrap_ids(fx.part_entries(spark, d)), p.MAX_LONG - 300, WRAP_BOTTOM, WRAP_TOP
        ).select("id", "file_name"),
        fx.sql(
            "part_entries",
            """SELECT id, file_name FROM wrapped WHERE NOT (id BETWEEN 9223372036854775508 AND 9223372036854775806
OR id BETWEEN -9223372036854775807 AND -9223372036854775807 - 1 + 1300)""",
            WRAP_SQL,
        ),
    ),
    "limit_by_unit_size": Query(
        limit_by_unit_size,
        fx.sql(
            "units",
            """SELECT doc_id, e.epoch_id, e.leader_id, e.entry_id, file_name FROM entries e JOIN units u
ON e.epoch_id = u.epoch_id AND e.leader_id = u.leader_id
WHERE u.num_entries - u.epoch_id * 7 > 0 AND e.entry_id < u.num_entries - u.epoch_id * 7""",
        ),
    ),
    "project_entry_hash": Query(
        lambda spark, d: p.entry_hashes(fx.entries(spark, d)),
        fx.sql("entries", "SELECT epoch_id, leader_id, entry_id, '' AS leader_key, hash FROM entries"),
    ),
    "project_node_state": Query(
        lambda spark, d: p.node_state(fx.peers(spark, d)),
        fx.sql(
            "peers",
            "SELECT node_id, partition_id, depth, CAST(NULL AS BIGINT) AS leader_id, num_entries FROM peers",
        ),
    ),
    "sort_entries": _entry_filter(p.sort_entries, f"true {ORDER}"),
    "sort_units": Query(
        lambda spark, d: p.sort_units(fx.units(spark, d)),
        fx.sql("units", "SELECT * FROM units ORDER BY epoch_id, leader_id, num_entries"),
    ),
    "topn_sorted": Query(
        _sorted_parts,
        fx.sql("part_entries", "SELECT * FROM part_entries ORDER BY file_size, id LIMIT 50"),
    ),
    "sort_peers_natural": Query(
        lambda spark, d: sort_peers_natural(fx.peers(spark, d)).select("node_id", "num_entries"),
        fx.sql(
            "peers",
            "SELECT node_id, num_entries FROM peers ORDER BY is_lg_member, category_id, depth, partition_id, num_entries, node_id DESC",
        ),
    ),
    "overlay_encode": Query(
        _overlay_encode,
        fx.sql(
            "peers",
            f"SELECT node_id, CASE WHEN partition_id <= 1023 THEN {PACK32} END AS overlay_id FROM wild",
            "wild AS (SELECT node_id, depth, category_id, partition_id * age * 20 AS partition_id FROM peers)",
        ),
    ),
    "overlay_decode": Query(
        _overlay_decode,
        fx.sql(
            "peers",
            "SELECT node_id, CASE depth WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS kind, depth, partition_id, category_id FROM peers",
        ),
    ),
    "shard_of_node": Query(
        _shard_bits(lambda node, part, depth: overlay.shard_of_node(node, depth)),
        _bits_sql("node_id & ((1::BIGINT << depth) - 1)"),
    ),
    "split_side": Query(
        _shard_bits(lambda node, part, depth: overlay.split_side(node, depth)),
        _bits_sql("(node_id >> depth) & 1"),
    ),
    "sibling_partition": Query(
        _shard_bits(lambda node, part, depth: overlay.sibling_partition(part, depth)),
        _bits_sql("CASE WHEN depth = 0 THEN 0 ELSE xor(partition_id, 1::BIGINT << (depth - 1)) END"),
    ),
    "parent_partition": Query(
        _shard_bits(lambda node, part, depth: overlay.parent_partition(part, depth)),
        _bits_sql("partition_id & ((1::BIGINT << greatest(depth - 1, 0)) - 1)"),
    ),
    "is_extension": Query(
        _is_extension,
        fx.sql(
            "peers",
            """SELECT node_id, (depth = 1 AND partition_id = node_id % 2)
OR (depth > 1 AND (node_id + age) % 2 = node_id % 2) AS result FROM peers""",
        ),
    ),
    "partition_bits": Query(
        _shard_bits(
            lambda node, part, depth: F.concat_ws(
                ",", F.transform(overlay.partition_bits(part, depth), lambda b: b.cast("string"))
            )
        ),
        _bits_sql(
            """CASE WHEN depth = 0 THEN 'false' ELSE array_to_string(list_transform(range(0, depth),
lambda i: CASE WHEN ((partition_id >> i) & 1) = 1 THEN 'true' ELSE 'false' END), ',') END"""
        ),
    ),
    "id_compare": Query(
        _id_compare,
        fx.sql(
            "entries",
            f"SELECT doc_id, CASE WHEN {TUPLE} < (3, 101, 20) THEN -1 WHEN {TUPLE} > (3, 101, 20) THEN 1 ELSE 0 END AS result FROM entries",
        ),
    ),
    "entry_digest": Query(
        _entry_digest, fx.sql("entries", f"SELECT doc_id, {DIGEST_SQL} AS digest FROM entries")
    ),
    "digest_audit": Query(
        _digest_audit,
        fx.sql("entries", f"SELECT doc_id, {DIGEST_SQL} AS expected FROM entries WHERE file_size % 9 = 0"),
    ),
    "page_bounds": Query(
        lambda spark, d: fx.part_entries(spark, d).select(
            "id",
            page_end(F.col("id"), F.col("file_size") - 25, F.lit(1500)).alias("page_to"),
        ),
        fx.sql(
            "part_entries",
            "SELECT id, least(id + CASE WHEN file_size - 25 <= 0 THEN 10 ELSE file_size - 25 END, 1500) AS page_to FROM part_entries",
        ),
    ),
    "majority": Query(
        lambda spark, d: fx.part_entries(spark, d).select("id", majority(F.col("file_size")).alias("quorum")),
        fx.sql("part_entries", "SELECT id, CAST(floor(file_size / 2.0 + 0.5) AS BIGINT) AS quorum FROM part_entries"),
    ),
    "round2": Query(
        lambda spark, d: fx.events(spark, d).select("event_id", round2(F.col("value") / 7).alias("rounded")),
        "SELECT event_id, floor(100.0::DOUBLE * (value / 7) + 0.5) / 100.0::DOUBLE AS rounded FROM events",
    ),
}
