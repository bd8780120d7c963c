"""Queries that apply the operators to the provided tables, each with the SQL that says the same.

The tables hold no books, so other tables stand for them: conversations are books with turns as chapters, regions hold
nations and customers as chapters of three levels, a customer's orders are a manifest, events are reading positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as X
from ..functions.markdown import with_markdown
from ..functions.paths import basename, dirname, extname, join_path, stem
from ..grouped import map_groups
from ..operators import chapters as C
from ..operators import content as T
from ..operators import naming
from ..operators import notes as N
from ..operators import vault as V
from ..sources import archives as A
from ..sources import package as S
from ..storage import shared_folder
from ..streaming import progress as P
from .importer import Import, import_books, import_folders, import_libraries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_UTF16 = "CAST(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS INTEGER)"
_NAME = "regexp_replace(regexp_replace({0}, '[<>:\"\\\\/|?*]+', '_', 'g'), '[. ]+\\z', '')"


@_query(f"""SELECT conv_id, turn, role AS name, coalesce(lag(role) OVER w, '') AS prev, coalesce(lead(role) OVER w, '') AS next,
  CAST(row_number() OVER w AS INTEGER) AS chapter_index, {_UTF16.format("text")} AS total_chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def q01_chapter_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("name"), X.utf16_length(F.col("text")).alias("total_chars"))
    return N.neighbours(turns, "conv_id", "turn", "name")


_TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"


@_query(f"SELECT page_id, {_TITLE} AS title, {_NAME.format(_TITLE)} AS file_name FROM pages")
def q02_title_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = X.html_title(F.col("html"))
    return _read(spark, sf_dir, "pages").select("page_id", title.alias("title"), X.file_name(title).alias("file_name"))


def _put_sql(variables: list[tuple[str, str]], template: str, table: str, key: str) -> str:
    """One step a name; in a value '$$', '$&', "$`" and "$'" stand for '$', the name, what is before and what is after it."""
    steps = [f"t0 AS (SELECT *, '{template}' AS t FROM {table})"]
    for k, (name, value) in enumerate(variables, 1):
        braced, pattern = f"{{{{{name}}}}}", "'\\$[$&`'']'"
        steps.append(f"p{k} AS (SELECT *, string_split(t, '{braced}') AS parts, string_split_regex(coalesce({value}, ''), {pattern}) AS between, regexp_extract_all(coalesce({value}, ''), {pattern}) AS marks FROM t{k - 1})")
        given = f"CASE marks[j] WHEN '$$' THEN '$' WHEN '$&' THEN '{braced}' WHEN '$`' THEN array_to_string(parts[1:i - 1], '{braced}') WHEN '$''' THEN array_to_string(parts[i:], '{braced}') ELSE '' END"
        steps.append(f"t{k} AS (SELECT * EXCLUDE (t, parts, between, marks), array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN x ELSE array_to_string(list_transform(between, lambda y, j: y || {given}), '') || x END), '') AS t FROM p{k})")
    return f"WITH {', '.join(steps)} SELECT {key}, t AS note FROM t{len(variables)}"


@_query(_put_sql([("title", "source"), ("content", "text"), ("lang", "lang"), ("size", "CAST(n_chars AS VARCHAR)")], "# {{title}} [{{lang}}] {{title}} {{content}} {{size}}", "documents", "doc_id"))
def q03_template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [("title", F.col("source")), ("content", F.col("text")), ("lang", F.col("lang")), ("size", F.col("n_chars").cast("string"))]
    return _read(spark, sf_dir, "documents").select("doc_id", X.render("# {{title}} [{{lang}}] {{title}} {{content}} {{size}}", values).alias("note"))


@_query("""WITH p AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
  lambda x, i: CASE WHEN i % 3 = 1 THEN repeat('#', CAST(2 + (doc_id + i) % 3 AS INTEGER)) || ' ' || x ELSE x END), chr(10)) AS t FROM documents),
d AS (SELECT doc_id, t, length(regexp_extract(t, '(?m)^(#{1,6}) ', 1)) - 1 AS d FROM p)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?m)^# ') OR d < 0 THEN t ELSE array_to_string(list_transform(string_split(t, chr(10)),
  lambda x: CASE WHEN regexp_matches(x, '^#{1,6} ') THEN repeat('#', CAST(greatest(1, length(regexp_extract(x, '^(#{1,6}) ', 1)) - d) AS INTEGER)) || regexp_replace(x, '^#{1,6}', '') ELSE x END), chr(10)) END AS md FROM d""")
def q04_heading_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i + 1) % 3 == 1, F.concat(F.repeat(F.lit("#"), (2 + (F.col("doc_id") + i + 1) % 3).cast("int")), F.lit(" "), x)).otherwise(x))
    marked_docs = _read(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("t"))
    return marked_docs.select("doc_id", X.normal_headings(F.col("t")).alias("md"))


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as books; the region, its nations and their customers as chapters in preorder."""
    region, nation, customer = (_read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    key = lambda c, base: (F.col(c).cast("long") + base).alias("id")
    root = region.select(F.col("r_regionkey").alias("book_id"), key("r_regionkey", 0), F.col("r_regionkey").cast("long").alias("ord"))
    nations = nation.select(F.col("n_regionkey").alias("book_id"), key("n_nationkey", 1000), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_nationkey").cast("long").alias("ord"))
    customers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("book_id"), key("c_custkey", 100000), (F.col("n_nationkey").cast("long") + 1000).alias("parent_id"), F.col("c_custkey").alias("ord"))
    names = region.select(key("r_regionkey", 0), F.col("r_name").alias("name")).unionByName(nation.select(key("n_nationkey", 1000), F.col("n_name").alias("name"))).unionByName(customer.select(key("c_custkey", 100000), F.col("c_name").alias("name")))
    placed = C.preorder(nations.unionByName(customers), root)
    return C.with_path_ids(placed, 2).join(names, "id").select("book_id", "chapter_pos", "level", "path_ids", "name")


_TREE = """WITH RECURSIVE n AS (
  SELECT n_regionkey AS book_id, CAST(1000 + n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS parent_id, CAST(n_nationkey AS BIGINT) AS ord, n_name AS name FROM nation
  UNION ALL SELECT n_regionkey, 100000 + c_custkey, 1000 + n_nationkey, c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT r_regionkey AS book_id, CAST(r_regionkey AS BIGINT) AS id, 0 AS level, [CAST(r_regionkey AS BIGINT)] AS path, [CAST(r_regionkey AS BIGINT)] AS ids, [r_name] AS names, r_name AS name FROM region
  UNION ALL SELECT n.book_id, n.id, level + 1, list_append(path, ord), list_append(ids, n.id), list_append(names, n.name), n.name FROM h JOIN n ON n.book_id = h.book_id AND n.parent_id = h.id),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY path) - 1 AS INTEGER) AS chapter_pos FROM h)
"""


@_query(_TREE + "SELECT book_id, chapter_pos, level, name FROM o")
def q05_toc_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchy(spark, sf_dir).select("book_id", "chapter_pos", "level", "name")


@_query(_TREE + """, w AS (SELECT o.book_id, o.chapter_pos, o.name, p.chapter_pos AS owner FROM o JOIN o p ON p.book_id = o.book_id AND p.id = o.ids[least(o.level, 1) + 1])
SELECT book_id, owner AS chapter_pos, string_agg(name, chr(10) || chr(10) ORDER BY chapter_pos) AS content FROM w GROUP BY book_id, owner""")
def q06_rollup_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = _hierarchy(spark, sf_dir)
    sections = chapters.select("book_id", "chapter_pos", F.lit(0).alias("section_ord"), F.col("name").alias("md"))
    return N.roll_up(sections, chapters, 1).select("book_id", "chapter_pos", "content")


@_query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def q07_rollup_depth0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.ordered_concat(_read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", "content", "\n\n")


@_query(_TREE + "SELECT book_id, string_agg(repeat(chr(9), level) || '- [[' || array_to_string(names, '/') || '|' || name || ']]' || chr(10), '' ORDER BY chapter_pos) AS body FROM o GROUP BY book_id")
def q08_moc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = N.note_names(_hierarchy(spark, sf_dir).withColumn("n_children", F.lit(0)), 2)
    lines = chapters.withColumn("line", N.index_line(F.col("level"), F.col("rel_path"), F.col("name")))
    return N.ordered_concat(lines, ["book_id"], ["chapter_pos"], "line", "body", "")


@_query(_TREE + """, k AS (SELECT DISTINCT book_id, ids[level] AS id FROM o WHERE level > 0)
SELECT o.book_id, chapter_pos, array_to_string(CASE WHEN level < 1 AND k.id IS NOT NULL THEN list_append(names, name) ELSE names END, '/') AS rel_path
FROM o LEFT JOIN k ON k.book_id = o.book_id AND k.id = o.id WHERE level <= 1""")
def q09_note_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = _hierarchy(spark, sf_dir)
    below = chapters.where("level > 0").groupBy("book_id", F.element_at("path_ids", -2).alias("chapter_pos")).agg(F.count("*").cast("int").alias("n_children"))
    counted = chapters.join(below, ["book_id", "chapter_pos"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return N.note_names(counted, 1).select("book_id", "chapter_pos", "rel_path")


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chapters placed in the manifest, manifest): a customer's orders without those of low priority are its manifest."""
    orders = _read(spark, sf_dir, "orders").withColumn("book_id", F.col("o_custkey")).withColumn("path", F.concat(F.lit("o"), "o_orderkey", F.lit(".html")))
    by = lambda *c: (F.row_number().over(Window.partitionBy("book_id").orderBy(*c)) - 1).cast("int")
    manifest = orders.where("o_orderpriority <> '5-LOW'").select("book_id", by("o_orderkey").alias("item_ord"), "path")
    toc = orders.where("o_orderstatus = 'F'").select("book_id", by("o_totalprice", "o_orderkey").alias("chapter_pos"), F.col("path").alias("file_path"))
    return C.positions(toc, manifest), manifest


_PLACED = """WITH m AS (SELECT o_custkey AS book_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS item_ord, 'o' || o_orderkey || '.html' AS path FROM orders WHERE o_orderpriority <> '5-LOW'),
t AS (SELECT o_custkey AS book_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS INTEGER) AS chapter_pos, 'o' || o_orderkey || '.html' AS file_path FROM orders WHERE o_orderstatus = 'F'),
p AS (SELECT t.book_id, chapter_pos, coalesce(item_ord, -1) AS idx FROM t LEFT JOIN m ON m.book_id = t.book_id AND m.path = t.file_path),
u AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.book_id = m.book_id AND p.idx = m.item_ord))
"""


@_query(_PLACED + "SELECT book_id, chapter_pos, idx FROM p")
def q10_position_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir)[0].select("book_id", "chapter_pos", "idx")


@_query(_PLACED + "SELECT book_id, item_ord, path FROM u")
def q11_unmapped_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unmapped(*_orders(spark, sf_dir)).select("book_id", "item_ord", "path")


@_query(_PLACED + "SELECT book_id, item_ord, path, (SELECT max(chapter_pos) FROM p WHERE p.book_id = u.book_id AND p.idx < u.item_ord) AS parent_pos FROM u")
def q12_last_smaller_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, manifest = _orders(spark, sf_dir)
    return C.last_smaller(placed, C.unmapped(placed, manifest))


def _turn_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("html"), (F.col("role") == "user").alias("anchor"))


@_query("""WITH p AS (SELECT conv_id, turn, role, string_agg(text, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prefix FROM conversations),
c AS (SELECT conv_id, turn AS place, prefix AS html FROM p WHERE role = 'user' AND prefix <> ''
  UNION ALL SELECT conv_id, max(turn) + 1, string_agg(text, '' ORDER BY turn) FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS INTEGER) AS chunk, html FROM c WHERE html <> ''""")
def q13_cumulative_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.split_chunks(_turn_nodes(spark, sf_dir), "reference", ("conv_id",), "turn").select("conv_id", "chunk", "html")


@_query("""WITH b AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations),
c AS (SELECT *, sum(CASE WHEN role = 'user' AND coalesce(before, 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS chunk FROM b),
j AS (SELECT conv_id, CAST(chunk AS INTEGER) AS chunk, string_agg(text, '' ORDER BY turn) AS html FROM c GROUP BY conv_id, chunk)
SELECT * FROM j WHERE html <> ''""")
def q14_disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.split_chunks(_turn_nodes(spark, sf_dir), "disjoint", ("conv_id",), "turn").select("conv_id", "chunk", "html")


@_query("SELECT l_orderkey AS file, l_partkey, l_quantity FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n = 1")
def q15_whole_file_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), "l_partkey", "l_quantity")
    return T.sole(lines, ("file",))


@_query(r"""WITH r AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"\]\n]*)"[^>]*>', 1)) AS raw FROM pages),
b AS (SELECT page_id, raw, split_part(split_part(raw, '|', 1), '#', 1) AS base, split_part(split_part(raw, '|', 1), '#', 2) AS fragment, split_part(raw, '|', 2) AS display FROM r)
SELECT page_id, raw, base, fragment, display, (contains(base, '.html') OR contains(base, '.xhtml')) AND fragment <> '' AS resolvable FROM b""")
def q16_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"\]\n]*)"[^>]*>'), 1)
    notes = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"), F.lit(0).alias("chapter_pos"), F.array_join(F.transform(hrefs, lambda h: F.concat(F.lit("[["), h, F.lit("]]"))), "\n").alias("content"))
    return N.links(notes).select(F.col("book_id").alias("page_id"), "raw", "base", "fragment", "display", "resolvable")


@_query(r"""WITH s AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS book_id, page_id, url, split_part(url, '#', 2) AS fragment FROM pages),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_id) - 1 AS INTEGER) AS chapter_pos FROM s),
f AS (SELECT book_id, fragment, min(chapter_pos) AS target_pos FROM o WHERE fragment <> '' GROUP BY book_id, fragment)
SELECT o.book_id, o.chapter_pos, o.page_id, t.page_id AS target_page, '[[page ' || t.page_id || '|page ' || t.page_id || ']]' AS replacement
FROM o JOIN f ON f.book_id = o.book_id AND f.fragment = o.fragment JOIN o t ON t.book_id = f.book_id AND t.chapter_pos = f.target_pos""")
def q17_link_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("book_id"), "page_id", X.url_fragment(F.col("url")).alias("fragment"))
    placed = pages.withColumn("chapter_pos", (F.row_number().over(Window.partitionBy("book_id").orderBy("page_id")) - 1).cast("int"))
    name = F.concat(F.lit("page "), "page_id")
    chapters = placed.select("book_id", "chapter_pos", F.array("chapter_pos").alias("path_ids"), F.lit(0).alias("level"), name.alias("name"), name.alias("original_name"))
    sections = placed.select("book_id", "chapter_pos", F.lit(0).alias("section_ord"), F.concat("page_id", F.lit(".html")).alias("file_path"), "fragment", F.lit("").alias("html"))
    notes = placed.select("book_id", "chapter_pos", F.concat(F.lit("see [["), "page_id", F.lit(".html#"), "fragment", F.lit("]]")).alias("content"))
    found = N.resolve(N.links(notes), N.link_targets(sections, chapters, 0), chapters).where("replacement IS NOT NULL")
    return found.join(placed.select("book_id", "chapter_pos", "page_id"), ["book_id", "chapter_pos"]).select("book_id", "chapter_pos", "page_id", F.regexp_extract("target", r"(\d+)", 1).cast("long").alias("target_page"), "replacement")


_UNIQUE = f"""WITH t AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, {_TITLE} AS title FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY host, title ORDER BY page_id) - 1 AS n FROM t)
SELECT page_id, host, CASE WHEN n = 0 THEN title ELSE title || ' (' || n || ')' END AS name FROM n"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), X.html_title(F.col("html")).alias("title"))


@_query(_UNIQUE)
def q18_unique_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By window: right while no title ends in a counter, and no task holds a host."""
    return naming.numbered_names(_titles(spark, sf_dir), ["host"], ["page_id"], "title", "name").select("page_id", "host", "name")


@_query(_UNIQUE)
def q19_unique_titles_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.with_unique(_titles(spark, sf_dir), ["host"], ["page_id"], "title", "name").select("page_id", "host", "name")


@_query()
def q20_html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_markdown(_read(spark, sf_dir, "pages").select("page_id", "html"), "html", "md").select("page_id", "md")


@_query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def q21_tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@_query("SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS by_member, contains(text, 'the') AS by_text FROM documents WHERE contains(text, 'the')")
def q22_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.where(V.has_tag(F.col("text"), "the", "string")).select("doc_id", V.has_tag(F.split("text", " "), "the").alias("by_member"), V.has_tag(F.col("text"), "the", "string").alias("by_text"))


@_query("SELECT page_id, url FROM pages WHERE contains(url, 'blog') AND ends_with(url, 'x')")
def q23_book_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pick(_read(spark, sf_dir, "pages"), "url", "blog").where(A.valid_path(F.col("url"), "x")).select("page_id", "url")


_LAST = "(SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"


@_query(f"SELECT user_id, event_id, event_type, value FROM {_LAST}")
def q24_latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest(_read(spark, sf_dir, "events"), ["user_id"], ["event_id", "event_type", "value"], ["ts", "event_id"])


def _ms(ts: str) -> F.Column:
    """Milliseconds since 1970 of a time without a zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(ts))


@_query(f"""WITH l AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM {_LAST}),
r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(ms, 0) DESC, c_custkey) AS n FROM customer LEFT JOIN l ON user_id = c_custkey)
SELECT 'index ' || c_nationkey AS path, 'c' || c_custkey || '.md' AS note FROM r WHERE n = 1""")
def q25_continue_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer")
    links = customers.select(F.concat(F.lit("index "), "c_nationkey").alias("path"), F.col("c_custkey").alias("link_ord"), F.concat(F.lit("c"), "c_custkey").alias("link"))
    notes = customers.select(F.concat(F.lit("c"), "c_custkey", F.lit(".md")).alias("path"))
    read = P.latest(_read(spark, sf_dir, "events"), ["user_id"], ["ts"], ["ts", "event_id"]).select(F.concat(F.lit("c"), "user_id", F.lit(".md")).alias("path"), _ms("ts").alias("ts_ms"))
    return V.continue_book(links, notes, read)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_log(_read(spark, sf_dir, "events"))


def _as_log(e: DataFrame) -> DataFrame:
    """Saves, and errors as deletes; a purchase renames its user's note to the next user's."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "rename").otherwise("save")
    name = lambda c: F.concat(F.lit("u"), c)
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), name(F.col("user_id").cast("string")).alias("path"), name((F.col("user_id") + 1).cast("string")).alias("new_path"), F.col("value").alias("scroll"), _ms("ts").alias("ts_ms"))


@_query("SELECT 'u' || user_id AS path, scroll, ts_ms FROM (SELECT user_id, event_type, value AS scroll, epoch_us(ts) // 1000 AS ts_ms FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
def q26_progress_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return P.apply_log(log.withColumn("op", F.when(F.col("op") == "rename", "save").otherwise(F.col("op"))))


_RENAMED = """WITH RECURSIVE e AS (SELECT event_id AS seq, user_id AS u, event_type AS op, value AS scroll, epoch_us(ts) // 1000 AS ts_ms FROM events),
s AS (SELECT u, seq, op, coalesce(lag(seq) OVER (PARTITION BY u ORDER BY seq), -1) AS prev FROM e WHERE op IN ('error', 'purchase')),
r AS (SELECT u, seq AS at, [seq] AS arrivals, scroll, ts_ms FROM e WHERE op NOT IN ('error', 'purchase')
  UNION ALL SELECT r.u + 1, s.seq, list_prepend(s.seq, arrivals), scroll, ts_ms FROM r JOIN s ON s.u = r.u AND s.prev < r.at AND r.at < s.seq WHERE s.op = 'purchase'),
f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.u = r.u AND r.at < s.seq))
SELECT 'u' || u AS path, scroll, ts_ms FROM f QUALIFY row_number() OVER (PARTITION BY u ORDER BY arrivals DESC) = 1"""


@_query(_RENAMED)
def q27_progress_with_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.apply_log(_log(spark, sf_dir))


@_query(f"SELECT doc_id, {_UTF16.format('text')} AS total_chars FROM documents")
def q28_total_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", X.utf16_length(F.col("text")).alias("total_chars"))


@_query(r"SELECT page_id, split_part(url, '#', 1) AS path, split_part(url, '#', 2) AS fragment, regexp_matches(split_part(url, '#', 1), '(?i)\.(htm|html|xhtml)\z') AS is_html FROM pages")
def q29_url_split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = X.url_path(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", path.alias("path"), X.url_fragment(F.col("url")).alias("fragment"), X.is_html_path(path).alias("is_html"))


@_query("SELECT l_partkey, l_suppkey, count(*) AS n_sections FROM lineitem GROUP BY l_partkey, l_suppkey")
def q30_distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n_sections"))


@_query("SELECT root_ord, count(*) AS n_books FROM (SELECT 0 AS root_ord FROM supplier UNION ALL SELECT 1 FROM customer UNION ALL SELECT 2 FROM supplier) GROUP BY root_ord")
def q31_library_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = [("supplier", "s_name"), ("customer", "c_name"), ("supplier", "s_name")]
    rows = [_read(spark, sf_dir, t).select(F.lit(k).alias("root_ord"), F.col(c).alias("path")) for k, (t, c) in enumerate(roots)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("root_ord").agg(F.count("*").alias("n_books"))


@_query("SELECT 'u' || user_id AS path, scroll, ts_ms FROM (SELECT user_id, value AS scroll, epoch_us(ts) // 1000 AS ts_ms FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, value DESC) = 1)")
def q32_streaming_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into snapshots of the state, until all are taken."""
    # as a pattern, since a stream takes a single file no other way
    stream = spark.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    events = stream.select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("value").alias("scroll"), _ms("ts").alias("ts_ms"))
    folder = shared_folder(spark, "stream")
    P.track(events, f"{folder}/state", f"{folder}/checkpoint", every=None).awaitTermination()
    return P.current(spark, f"{folder}/state")


@_query("SELECT 'u' || user_id AS path, value AS scroll, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q33_progress_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State as JSON members, one file a path, and read back."""
    clicks = _read(spark, sf_dir, "events").where("event_type = 'click'")
    state = P.latest(clicks, ["user_id"], ["value", "ts"], ["ts", "event_id"]).select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("value").alias("scroll"), _ms("ts").alias("ts_ms"))
    files = P.dump(state).select(F.concat(F.lit('{"'), "path", F.lit('":'), "value", F.lit("}")).alias("value"))
    return P.load(files)


@_query(r"""WITH u AS (SELECT page_id, regexp_replace(split_part(url, '#', 1), '\?.*', '') AS p FROM pages), b AS (SELECT page_id, p, regexp_extract(p, '([^/]*)/*\z', 1) AS base FROM u),
x AS (SELECT *, regexp_extract(base, '(?s)[^.].*?(\.[^.]*)\z', 1) AS ext FROM b)
SELECT page_id, base, ext, substring(base, 1, length(base) - length(ext)) AS stem, CASE WHEN regexp_extract(p, '(?s)\A(.*[^/])/+[^/]+/*\z', 1) <> '' THEN regexp_extract(p, '(?s)\A(.*[^/])/+[^/]+/*\z', 1) WHEN starts_with(p, '/') THEN '/' ELSE '.' END AS folder FROM x""")
def q34_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_replace(X.url_path(F.col("url")), r"\?.*", "")
    return _read(spark, sf_dir, "pages").select("page_id", p.alias("p")).select("page_id", basename(F.col("p")).alias("base"), extname(F.col("p")).alias("ext"), stem(F.col("p")).alias("stem"), dirname(F.col("p")).alias("folder"))


@_query("SELECT 'vault/conv' || conv_id || '/' || turn || '.md' AS path, text AS content FROM conversations")
def q35_zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as archives and back to files."""
    files = _read(spark, sf_dir, "conversations").select(F.concat(F.lit("conv"), "conv_id").alias("book"), F.concat("turn", F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("bytes"))
    archives = V.zip_books(files).select(F.concat(F.lit("/backup/"), "book", F.lit(".zip")).alias("path"), F.col("zip").alias("content"))
    return V.unzip_books(archives, "vault").select("path", F.decode("bytes", "UTF-8").alias("content"))


@_query("""SELECT 'c' || c_custkey || '.md' AS path, CASE WHEN c_custkey % 10 = 0 THEN 'c' || c_custkey || '.md' WHEN c_custkey // 10 * 10 + 1 = c_custkey OR c_custkey % 2 = 0 THEN 'c' || c_custkey // 10 * 10 || '.md' END AS index_path FROM customer""")
def q36_note_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth note is an index, which links to the even ones of its ten and to the next."""
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    ten = F.expr("k div 10 * 10")
    notes = customers.select(F.concat(F.lit("c"), "k", F.lit(".md")).alias("path"))
    indexes = customers.where("k % 10 = 0").select(F.concat(F.lit("c"), "k", F.lit(".md")).alias("path"), F.col("k").alias("file_ord"))
    links = customers.where("k % 10 = 1 OR k % 2 = 0").select(F.concat(F.lit("c"), ten, F.lit(".md")).alias("path"), F.concat(F.lit("c"), "k").alias("link"))
    return V.note_index(notes, indexes, links)


def _page(turn: int) -> str:
    return f"<html><head><title>page {turn}</title></head><body><p>turn {turn} of the talk</p></body></html>"


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archives(path, content): a conversation as a book whose navigation names the user's turns alone."""
    import io
    import zipfile

    def run(rows: list[tuple]) -> list[tuple]:
        conv, turns = rows[0][0], [row[1] for row in rows]
        items = "".join(f'<item id="t{t}" href="text/t{t}.xhtml"/>' for t in turns)
        points = "".join(f'<navPoint><navLabel><text>turn {t}</text></navLabel><content src="text/t{t}.xhtml"/></navPoint>' for _, t, r in rows if r == "user")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("OPS/book.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Talk {conv}</dc:title><dc:creator role="aut">N. N.</dc:creator></metadata><manifest>{items}</manifest></package>')
            z.writestr("OPS/book.ncx", f"<ncx><navMap>{points}</navMap></ncx>")
            for t in turns:
                z.writestr(f"OPS/text/t{t}.xhtml", _page(t))
        return [(f"/library/talk{conv}.epub", out.getvalue())]

    return map_groups(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"], run, "path string, content binary")


_IMPORTED = """WITH o AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS up FROM conversations),
c AS (SELECT conv_id, turn, coalesce(up, turn) AS chapter, up IS NULL AS made FROM o),
n AS (SELECT conv_id, chapter, made, string_agg('turn ' || turn || ' of the talk', chr(10) || chr(10) ORDER BY turn) AS content, CASE WHEN made THEN 'page ' ELSE 'turn ' END || chapter AS name FROM c GROUP BY conv_id, chapter, made)
"""


@_query(_IMPORTED + """SELECT 'talk' || conv_id AS book, CAST(row_number() OVER w - 1 AS INTEGER) AS chapter_pos, 'talk' || conv_id || '/' || name || '.md' AS note_path, content,
  coalesce(lag(name) OVER w, '') AS prev, coalesce(lead(name) OVER w, '') AS next, CAST(length(content) AS INTEGER) AS total_chars FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY made, chapter)""")
def q37_import_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole import: archives to notes."""
    notes = import_books(_packed(spark, sf_dir), Settings()).notes
    return notes.select(stem(F.col("book_id")).alias("book"), "chapter_pos", "note_path", "content", "prev", "next", "total_chars")


@_query(_IMPORTED + """SELECT 'talk' || conv_id || '/talk' || conv_id || '.md' AS index_path, '---' || chr(10) || 'title: talk' || conv_id || chr(10) || 'author: N. N.' || chr(10) || 'publisher: ""' || chr(10) || 'status: false' || chr(10) || 'tags:' || chr(10) || '  - book' || chr(10) || chr(10) || '---' || chr(10)
  || string_agg('- [[talk' || conv_id || '/' || name || '.md|' || name || ']]' || chr(10), '' ORDER BY made, chapter) AS content FROM n GROUP BY conv_id""")
def q38_import_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_books(_packed(spark, sf_dir), Settings()).index.select("index_path", "content")


def _anchored(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A folder of books written from conversations: one page holds all turns, and the navigation names its anchors.

    kind "archives": .epub files on three shelves, every tenth broken; "folders": a folder for each book.
    """
    import io
    import zipfile

    def book(turns: list[int], conv: int) -> dict[str, str]:
        points = "".join(f'<navPoint><navLabel><text>part {t}</text></navLabel><content src="all.xhtml#s.{t}"/></navPoint>' for t in turns)
        body = "".join(f'<h4 id="s.{t}">part {t}</h4>\n<p>said {t} &amp; done, see <a href="all.xhtml#s.{turns[-1]}">last</a></p>' for t in turns)
        return {
            "book.opf": f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Talk {conv}</dc:title></metadata><manifest><item id="a" href="all.xhtml"/><item id="cover" href="i/front.png"/></manifest></package>',
            "book.ncx": f"<ncx><navMap>{points}</navMap></ncx>",
            "all.xhtml": f"<html><head><title>all</title></head><body>{body}</body></html>",
            "i/front.png": f"image of {conv}",
        }

    def run(rows: list[tuple]) -> list[tuple]:
        conv, turns = rows[0][0], [row[1] for row in rows]
        files = book(turns, conv)
        if kind == "folders":
            return [(f"talk{conv}/{p}", x.encode()) for p, x in files.items()]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for p, x in files.items():
                z.writestr(p, x)
        return [(f"shelf{conv % 3}/deep/talk{conv}.epub", b"no archive" if conv % 10 == 7 else out.getvalue())]

    root = shared_folder(spark, "library")
    files = map_groups(_read(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], run, "path string, bytes binary")
    V.write_files(files, root).write.format("noop").mode("overwrite").save()
    return root


def _library(spark: SparkSession, sf_dir: str) -> Import:
    root = _anchored(spark, sf_dir, "archives")
    return import_libraries(spark, Settings(libraries=tuple(f"{root}/shelf{k}" for k in range(3)), save_path="vault"))


_PARTS = """WITH c AS (SELECT conv_id, turn, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, count(*) OVER (PARTITION BY conv_id) AS n, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
"""
_PART = """'<h4 id="s.' || turn || '">part ' || turn || '</h4>{feed}<p>said ' || turn || ' {mark} done, see <a href="all.xhtml#s.' || top || '">last</a></p>'"""


@_query(_PARTS + f"""SELECT 'talk' || conv_id AS book, pos AS chapter_pos, 'all.xhtml#s.' || turn AS url, CASE WHEN n = 1
  THEN '<html><head><title>all</title></head><body>' || {_PART.format(feed="' || chr(10) || '", mark="&amp;")} || '</body></html>'
  ELSE string_agg({_PART.format(feed="", mark="&")}, '') OVER (PARTITION BY conv_id ORDER BY turn) END AS html FROM c WHERE conv_id % 10 <> 7""")
def q39_library_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives on disk, found below several libraries, their page split at anchors; chunks are cumulative and not escaped."""
    return _library(spark, sf_dir).sections.select(stem(F.col("book_id")).alias("book"), "chapter_pos", "url", "html")


@_query("""WITH b AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'attempted' AS kind, '' AS path, count(*) AS n FROM b UNION ALL SELECT 'error unzip', '', count(*) FROM b WHERE conv_id % 10 = 7 HAVING count(*) > 0
UNION ALL SELECT 'asset', 'vault/talk' || conv_id || '/images/front.png', length('image of ' || conv_id) FROM b WHERE conv_id % 10 <> 7""")
def q40_library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books found (broken ones too), errors, and the images that are copied."""
    got = _library(spark, sf_dir)
    counts = got.attempted.agg(F.lit("attempted").alias("kind"), F.lit("").alias("path"), F.count("*").alias("n"))
    errors = got.errors.groupBy(F.concat(F.lit("error "), "stage").alias("kind")).agg(F.lit("").alias("path"), F.count("*").alias("n"))
    return counts.unionByName(errors).unionByName(got.assets.select(F.lit("asset").alias("kind"), "path", F.octet_length("bytes").cast("long").alias("n")))


_FRONT = """'---' || chr(10) || 'title: talk' || conv_id || chr(10) || 'author: ""' || chr(10) || 'publisher: ""' || chr(10) || 'status: false' || chr(10) || 'tags:' || chr(10) || '  - book' || chr(10) || 'cover: /talk' || conv_id || '/images/front.png' || chr(10) || chr(10) || '---' || chr(10)"""


@_query(_PARTS + f"""SELECT 'talk' || conv_id || '/talk' || conv_id || '.md' AS note_path, {_FRONT} || string_agg('# part ' || turn || chr(10) || chr(10) || 'said ' || turn || ' & done, see [[all.xhtml#s.' || top || '|last]]', chr(10) || chr(10) ORDER BY turn) AS content FROM c GROUP BY conv_id""")
def q41_folder_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that are folders, each as one note with front matter; chunks hold each node once."""
    root = _anchored(spark, sf_dir, "folders")
    return import_folders(spark, root, Settings(granularity=0, split_mode="disjoint")).notes.select("note_path", "content")


@_query(_PARTS + """SELECT 'talk' || conv_id AS book, pos AS chapter_pos, 'all.xhtml#s.' || top AS raw, 'part ' || top AS target, '[[part ' || top || '|last]]' AS replacement FROM c""")
def q42_dotted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the notes of books that are folders: fragments with a dot lead to chapters."""
    root = _anchored(spark, sf_dir, "folders")
    got = import_folders(spark, root, Settings(split_mode="disjoint")).links
    return got.select(basename(F.col("book_id")).alias("book"), "chapter_pos", F.split("raw", r"\|")[0].alias("raw"), "target", "replacement")


@_query(_RENAMED)
def q43_streaming_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves, renames and deletes as a stream into snapshots of the state, until all are taken."""
    schema = _read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    folder = shared_folder(spark, "stream")
    P.track_log(_as_log(stream), f"{folder}/state", f"{folder}/checkpoint", every=None).awaitTermination()
    return P.current(spark, f"{folder}/state")


@_query("SELECT DISTINCT 'talk' || conv_id AS book FROM conversations WHERE starts_with(CAST(conv_id AS VARCHAR), '1')")
def q44_library_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives on disk whose path holds what was typed, at any depth; their content is not read."""
    return A.scan_libraries(spark, [_anchored(spark, sf_dir, "archives")], query="/talk1").select(stem(F.col("path")).alias("book"))


@_query("SELECT 'vault/conv' || conv_id || '/' || turn || '.md' AS path, text AS content FROM conversations WHERE starts_with(CAST(conv_id AS VARCHAR), '1')")
def q45_backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as archives in a backup folder, those that a query finds there, and their files."""
    root = shared_folder(spark, "backup")
    files = _read(spark, sf_dir, "conversations").select(F.concat(F.lit("conv"), "conv_id").alias("book"), F.concat("turn", F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("bytes"))
    zips = V.zip_books(files).select(F.concat("book", F.lit(".zip")).alias("path"), F.col("zip").alias("bytes"))
    V.write_files(zips, root).write.format("noop").mode("overwrite").save()
    found = A.scan_libraries(spark, [root], "*.zip", "/conv1")
    return V.unzip_books(found, "vault").select("path", F.decode("bytes", "UTF-8").alias("content"))


@_query("""WITH b AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'skip' AS mode, '/library/talk' || conv_id || '.epub' AS path FROM b WHERE conv_id % 3 <> 0 UNION ALL SELECT 'overwrite', '/library/talk' || conv_id || '.epub' FROM b""")
def q46_existing_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that are read, where every third has its folder already."""
    books = _read(spark, sf_dir, "conversations").select("conv_id").distinct()
    archives = books.select(F.concat(F.lit("/library/talk"), "conv_id", F.lit(".epub")).alias("path"))
    existing = books.where("conv_id % 3 = 0").select(F.concat(F.lit("talk"), "conv_id").alias("stem"))
    skip, overwrite = (A.only_new(archives, existing, m).select(F.lit(m).alias("mode"), "path") for m in ("skip", "overwrite"))
    return skip.unionByName(overwrite)


@_query("""WITH e AS (SELECT p_partkey, p_name, p_partkey % 50 AS book, p_partkey % 20 || ['.png', '.svg', '.jpg', '.jpeg', '.PNG'][p_partkey % 5 + 1] AS asset FROM part)
SELECT CAST(book AS VARCHAR) AS book_id, asset, arg_max(p_name, p_partkey) AS content FROM e WHERE regexp_matches(asset, '\\.(png|jpg|jpeg)$') GROUP BY book, asset""")
def q47_image_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images are copied by their names alone: of those that share one within a book the last stays."""
    ending = F.element_at(F.array(*map(F.lit, (".png", ".svg", ".jpg", ".jpeg", ".PNG"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("d"), "p_partkey", F.lit("/"), F.col("p_partkey") % 20, ending)
    entries = _read(spark, sf_dir, "part").select((F.col("p_partkey") % 50).cast("string").alias("book_id"), F.col("p_partkey").alias("entry_ord"), path.alias("entry_path"), F.encode("p_name", "UTF-8").alias("bytes"))
    return A.images(entries).select("book_id", "asset", F.decode("bytes", "UTF-8").alias("content"))


@_query("SELECT s_suppkey, 'vault/' || s_name || '/images' AS assets_path, 'vault/' || s_name || '/images/' || s_suppkey || '.jpg' AS cover FROM supplier")
def q48_assets_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a book's images go, and its cover among them."""
    folder, cover = F.concat(F.lit("vault/"), "s_name"), F.concat(F.lit("OPS/img/"), "s_suppkey", F.lit(".jpg"))
    where = X.render(Settings().assets_path, [("bookName", basename(folder)), ("savePath", F.lit("vault"))])
    return _read(spark, sf_dir, "supplier").select("s_suppkey", where.alias("assets_path"), cover.alias("cover")).withColumn("cover", join_path(F.col("assets_path"), basename(F.col("cover"))))


@_query("""WITH s AS (SELECT user_id, value, epoch_us(ts) // 1000 AS ts_ms FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, value DESC) = 1)
SELECT 'u' || c_custkey AS path, value AS scroll, ts_ms FROM customer LEFT JOIN s ON user_id = c_custkey""")
def q49_progress_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each asked note, null for one that was never read."""
    events = _read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("value").alias("scroll"), _ms("ts").alias("ts_ms"))
    state = P.latest(events, ["path"], ["scroll", "ts_ms"], ["ts_ms", "scroll"])
    return P.lookup(state, _read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("path")))


@_query("SELECT c_name AS book FROM customer WHERE contains(c_name, '9')")
def q50_export_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexes = _read(spark, sf_dir, "customer").select(F.concat(F.lit("vault/x/"), "c_name", F.lit(".md")).alias("path"))
    return V.book_names(indexes, "9")


def _navigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of books that are nations: each customer is a page, an image, and two points, one below the other.

    Every third customer's upper point has an empty title; every second image is named as a cover.
    """
    customers = _read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("book_id"), "c_custkey", "c_name").withColumn("k", F.col("c_custkey").cast("string"))
    title = F.when(F.expr("c_custkey % 3 = 0"), F.lit('<text lang="en"/>')).otherwise(F.concat(F.lit("<text>"), "c_name", F.lit("</text>")))
    inner = F.concat(F.lit("<navPoint><navLabel><text>in "), "k", F.lit('</text></navLabel><content src="a%20b/'), "k", F.lit('.xhtml"/></navPoint>'))
    point = F.concat(F.lit("<navPoint><navLabel>"), title, F.lit('</navLabel><content src="a%20b/'), "k", F.lit('.xhtml#f"/>'), inner, F.lit("</navPoint>"))
    kind, ending = F.when(F.expr("c_custkey % 2 = 0"), "Front-Cover").otherwise("plate"), F.when(F.expr("c_custkey % 4 = 0"), ".svg").otherwise(".JPG")
    item = F.concat(F.lit('<item id="p'), "k", F.lit('" href="a%20b/'), "k", F.lit('.xhtml"/><item id="'), kind, F.lit('" href="img/'), "k", ending, F.lit('"/>'))

    def document(part, name: str, ord_: int, begin: str, end: str) -> DataFrame:
        whole = N.ordered_concat(customers.withColumn("part", part), ["book_id"], ["c_custkey"], "part", "all", "")
        return whole.select("book_id", F.col("book_id").alias("stem"), F.lit(ord_).alias("entry_ord"), F.lit(name).alias("entry_path"), F.encode(F.concat(F.lit(begin), "all", F.lit(end)), "UTF-8").alias("bytes"))

    opf = document(item, "OPS/book.opf", 0, '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title></metadata><manifest>', "</manifest></package>")
    ncx = document(point, "OPS/book.ncx", 1, "<ncx><navMap>", "</navMap></ncx>")
    return S.read_packages(opf.unionByName(ncx))


@_query("""WITH k AS (SELECT 'n' || c_nationkey AS book_id, c_custkey AS k, c_name, CAST(2 * row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 2 AS INTEGER) AS place FROM customer WHERE c_custkey % 3 <> 0)
SELECT book_id, place AS chapter_pos, -1 AS parent_pos, 0 AS level, c_name AS title, 'OPS/a b/' || k || '.xhtml#f' AS url, 1 AS n_children FROM k
UNION ALL SELECT book_id, place + 1, place, 1, 'in ' || k, 'OPS/a b/' || k || '.xhtml', 0 FROM k""")
def q51_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation documents: blanks in places are decoded, a point with an empty title goes with what is below it."""
    toc = S.table_of_contents(_navigated(spark, sf_dir))
    return toc.select("book_id", "chapter_pos", "parent_pos", "level", F.col("original_name").alias("title"), "url", "n_children")


@_query("""SELECT 'n' || c_nationkey AS book_id, 'OPS/img/' || min(CASE WHEN c_custkey % 4 = 2 THEN c_custkey END) || '.JPG' AS cover_path, count(*) AS n_pages, 'OPS/a%20b/' || min(c_custkey) || '.xhtml' AS first_page FROM customer GROUP BY c_nationkey""")
def q52_covers_and_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package documents: the first image that is named as a cover; pages keep blanks as they are written."""
    pages = F.when(F.col("part") == 0, F.get("manifest", F.lit(0))["path"])
    packages = _navigated(spark, sf_dir).select("book_id", "cover_path", F.size("manifest").cast("long").alias("n"), pages.alias("page"))
    return packages.groupBy("book_id").agg(F.max("cover_path").alias("cover_path"), F.sum("n").alias("n_pages"), F.max("page").alias("first_page"))


@_query("""WITH n AS (SELECT conv_id, turn, unnest([{'k': 1, 'h': '<p id="s' || turn || '">x < y<br></br></p>', 'a': true}, {'k': 3, 'h': '', 'a': false},
  {'k': 4, 'h': '<b data-id="s' || turn || '">z</b>', 'a': false}, {'k': 5, 'h': ' tail', 'a': false}]) AS x FROM conversations)
SELECT conv_id || '/' || turn AS file_path, CAST(x.k AS INTEGER) AS node_ord, x.h AS html, x.a AS anchor FROM n""")
def q53_body_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's nodes: line feeds between them go, comments are empty, and only an element's own id is an anchor."""
    own = F.concat(F.lit("s"), "turn")
    page = F.concat(F.lit('<html><BODY>\n<P id="'), own, F.lit('">x &lt; y<BR/></P>\n<!-- no --><b data-id="'), own, F.lit('">z</b> tail</BODY></html>'))
    files = _read(spark, sf_dir, "conversations").select(F.lit("b").alias("book_id"), F.concat_ws("/", "conv_id", "turn").alias("file_path"), page.alias("html"), F.array(own).alias("fragments"))
    return T.body_nodes(files).select("file_path", "node_ord", "html", "anchor")
