"""The rename engine (FLT-1/2, RNM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.keywords import with_category
from ..plans import rules as R
from ..plans.dictionary import CATEGORIES, PACK_RULES
from .fixtures import FILES, files, load

_NAME = "concat(CASE WHEN p_size % 3 = 0 THEN concat(CAST(p_size AS STRING), ' - ') WHEN p_size % 3 = 1 THEN ' -- ' ELSE '' END, p_name, CASE WHEN p_size % 4 = 0 THEN '  dj mix ' ELSE ' ' END, CAST(p_size % 12 AS STRING))"


def _names(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_NAME).alias("name"), F.col("p_brand").alias("group"), F.col("p_type").alias("instrument"),
                                          F.lit("").alias("bpm"), F.lit("Am").alias("key"), F.lit("").alias("category"), F.lit(False).alias("is_group"), F.col("p_size").cast("int").alias("index"))


def _op(spark, sf, **ops):
    return _names(spark, sf).withColumn("original", F.col("name")).select("id", *[R.compile_op(op, params, F.col("name")).alias(k) for k, (op, params) in ops.items()])


def rnm01_strip(spark, sf):
    return _op(spark, sf, number=("stripLeadingNumberPrefix", {}), dashes=("stripLeadingDashes", {}), trailing=("stripTrailingNumber", {}))


def rnm02_whitespace(spark, sf):
    return _op(spark, sf, collapsed=("collapseWhitespace", {}), trimmed=("trim", {}))


def rnm03_title_case(spark, sf):
    return _op(spark, sf, titled=("titleCase", {}))


def rnm04_add_text(spark, sf):
    return _op(spark, sf, first=("addTextAtBeginning", {"text": "{group}_"}), last=("addTextAtEnd", {"text": " [{key}]"}))


def rnm05_replace(spark, sf):
    return _op(spark, sf, literal=("replaceText", {"find": "SMALL", "replace": "tiny"}), cased=("replaceText", {"find": "SMALL", "replace": "tiny", "caseSensitive": True}),
               pattern=("replaceText", {"find": r"(\w+) (ring|bolt)", "replace": r"\2 \1", "regex": True}))


def rnm06_remove(spark, sf):
    return _op(spark, sf, anywhere=("removeText", {"text": "RING"}), start=("removeTextFromBeginning", {"text": " -- "}), end=("removeTextFromEnd", {"text": " 1"}))


def rnm07_char_range(spark, sf):
    return _op(spark, sf, cut=("removeCharRange", {"from": {"position": 2}, "to": {"position": 5}}), swapped=("removeCharRange", {"from": {"position": 1, "direction": "left"}, "to": {"position": 3}}))


def rnm08_pad(spark, sf):
    return _op(spark, sf, padded=("padNumericSuffix", {}))


def rnm09_tokens(spark, sf):
    return _names(spark, sf).withColumn("original", F.col("name")).select("id", R.template("{counter:3}-{instrument}-{user}-{nope}-{is_audio}", F.col("name"), {"User": "me"}).alias("text"))


_CATEGORIES = [
    {"name": "Metal", "keywords": "bolt, ring, rod", "affix": "METAL - "},
    {"name": "Machine", "keywords": "gear,widget,gizmo", "affix": "MACHINE - "},
    {"name": "Size", "keywords": "small ring", "affix": "SIZE - "},
    {"name": "Part", "keywords": "anv", "affix": "PART - ", "matchMode": "contains"},
]


def rnm10_category(spark, sf):
    best = R.best_category(F.col("name"), _CATEGORIES)
    return _names(spark, sf).select("id", best["category"].alias("category"), best["keyword"].alias("keyword"))


def rnm11_affix(spark, sf):
    return _names(spark, sf).select("id", R.add_affix(F.col("name"), _CATEGORIES[0]).alias("prefixed"), R.add_affix(F.col("name"), {"affix": " 1", "affixPosition": "suffix"}).alias("suffixed"))


def _plan(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("folder"), F.expr("concat(p_name, '_', p_partkey)").alias("source"),
                                          F.expr("CASE WHEN p_size % 5 = 0 THEN upper(p_name) WHEN p_size % 11 = 0 THEN '' ELSE p_name END").alias("target"), F.lit("wav").alias("ext"))


def rnm12_collisions(spark, sf):
    return R.resolve_collisions(_plan(spark, sf)).select("id", "final")


_RULES = [
    {"kind": "op", "op": "stripLeadingDashes"},
    {"kind": "op", "op": "stripLeadingNumberPrefix"},
    {"kind": "op", "op": "collapseWhitespace"},
    {"kind": "conditionGroup", "match": "any", "conditions": [{"operator": "contains", "value": "ring"}, {"operator": "equals", "value": "none"}],
     "children": [{"kind": "op", "op": "addTextAtEnd", "params": {"text": " (r)"}}],
     "branches": [{"conditions": [{"operator": "matches", "value": "^SMALL"}], "children": [{"kind": "op", "op": "addTextAtEnd", "params": {"text": " (s)"}}]},
                  {"children": [{"kind": "op", "op": "addTextAtEnd", "params": {"text": " (-)"}}]}]},
    {"kind": "op", "op": "categoryBundle", "params": {"categories": _CATEGORIES}},
]


def rnm13_rule_tree(spark, sf):
    rows = _names(spark, sf).withColumns({"original": F.col("name"), "current": F.col("name"), "matched_keyword": F.lit("")})
    return R.apply_rules(rows, _RULES[:4]).select("id", "current")


def rnm14_preview(spark, sf):
    return R.preview(_names(spark, sf).drop("index"), _RULES[:3]).drop("matched_keyword")


def rnm14_full_preview(spark, sf):
    return R.preview(_names(spark, sf).drop("index"), _RULES)


def rnm15_unique_folders(spark, sf):
    """Names within a brand; some are taken by folders that exist, some of them with a number."""
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_name", "p_size")
    existing = part.where("p_size % 6 = 0").select("p_brand", F.expr("CASE WHEN p_size % 4 = 0 THEN p_name ELSE concat(p_name, ' (', p_size % 5 + 1, ')') END").alias("p_name"))
    return R.unique_folders(part.drop("p_size"), "p_brand", "p_name", existing).select("id", "folder")


def rnm16_sequence(spark, sf):
    taken = load(spark, sf, "customer").where("c_custkey % 10 = 7").select(F.expr("concat('song_', lpad(c_custkey, greatest(4, length(c_custkey)), '0'))").alias("name"))
    return R.sequence_names(load(spark, sf, "part").select(F.col("p_partkey").alias("id")), "id", taken)


_SOUNDS = ("kick", "Congas", "sub", "Strum", "violins", "backing vocals", "ad lib", "Choir2", "risers", "", "trumpet_oboe", "hats", "padded")


def _sound(key):
    return F.element_at(F.array(*map(F.lit, _SOUNDS)), (F.col(key) % len(_SOUNDS) + 1).cast("int"))


def rnm17_dictionary(spark, sf):
    """Names that hold words of the dictionary, in several spellings, and words of the table, looked up in one pass."""
    named = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", _sound("p_partkey"), "p_size").alias("name"))
    return with_category(named, "name", CATEGORIES).select("id", "category", "keyword")


def rnm17_pack_rules(spark, sf):
    """The rule set of sample packs on the same names."""
    named = _names(spark, sf).join(load(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id")
    named = named.withColumn("name", F.concat(F.lit("01 - "), "p_name", F.lit("  "), _sound("id"), F.lit(" 7")))
    rows = named.withColumns({"original": F.col("name"), "current": F.col("name"), "matched_keyword": F.lit("")})
    return R.apply_rules(rows, PACK_RULES).select("id", "current", "matched_keyword")


def rnm18_label_category(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), R.label_category(F.concat_ws(" ", "p_name", F.expr("CASE WHEN p_size % 2 = 0 THEN 'machine' END")), _CATEGORIES).alias("category"))


def rnm19_prefix(spark, sf):
    prefix, rest = R.split_prefix(F.expr("concat(CASE WHEN size % 2 = 0 THEN concat(upper(category), ' - ') ELSE '' END, folder)"))
    return files(spark, sf).select("id", prefix.alias("prefix"), rest.alias("rest"))


def flt01_conditions(spark, sf):
    tests = {"contains": ("contains", "RING"), "not_contains": ("notContains", "ring"), "equals": ("equals", "red ring"), "matches": ("matches", "^(red|small)"), "empty": ("contains", " ")}
    named = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return named.select("id", *[R.condition({"operator": op, "value": v}, F.col("name")).alias(k) for k, (op, v) in tests.items()])


def flt02_condition_groups(spark, sf):
    both = [{"operator": "contains", "value": "ring"}, {"operator": "contains", "value": "small"}]
    named = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return named.select("id", R.conditions({"conditions": both}, F.col("name")).alias("all_of"), R.conditions({"conditions": both, "match": "any"}, F.col("name")).alias("any_of"), R.conditions({"conditions": []}, F.col("name")).alias("none"))


QUERIES = {k: v for k, v in globals().items() if k.startswith(("rnm", "flt0"))}

_N = f"SELECT p_partkey AS id, {_NAME} AS name, p_brand, p_type, p_size, p_name FROM part"
_STEP3 = r"regexp_replace(regexp_replace(regexp_replace(name, '^\s*(-\s*)+', ''), '^\d+\s*[-_.:)]\s*', ''), '\s+', ' ', 'g')"
_BEST = """CASE WHEN contains(p_name, 'small ring') THEN 2 WHEN contains(p_name, 'widget') OR contains(p_name, 'gizmo') THEN 1
  WHEN regexp_matches(p_name, '\\b(bolt|ring)s?\\b') THEN 0 WHEN contains(p_name, 'gear') THEN 1 WHEN regexp_matches(p_name, '\\brod\\b') THEN 0 WHEN contains(p_name, 'anv') THEN 3 END"""
_FOUND = """(SELECT p_partkey AS id, p_name, [%s][p_partkey %% 13 + 1] AS word,
  ['kick', 'conga', 'sub', 'strum', 'violin', 'backing vocal', 'ad lib', 'choir', 'riser', NULL, 'trumpet', 'hat', NULL][p_partkey %% 13 + 1] AS keyword,
  ['Drums', 'Percussion', 'Bass', 'Guitar', 'Strings', 'Vocals', 'Vocals', 'Vocals', 'Effects', NULL, 'Brass', 'Drums', NULL][p_partkey %% 13 + 1] AS category FROM part)""" % ", ".join(f"'{w}'" for w in _SOUNDS)
SQL = {
    "rnm17_dictionary": f"SELECT id, category, keyword FROM {_FOUND}",
    "rnm17_pack_rules": f"""SELECT id, CASE WHEN category IS NULL THEN '' ELSE upper(category) || ' - ' END || array_to_string(list_transform(regexp_extract_all(p_name || ' ' || CASE WHEN word = '' THEN '' ELSE word || ' ' END || '07', '\\s+|\\S+'),
      lambda w: upper(w[1]) || lower(w[2:])), '') AS current, coalesce(keyword, '') AS matched_keyword FROM {_FOUND}""",
    "rnm01_strip": rf"""SELECT id, regexp_replace(name, '^\d+\s*[-_.:)]\s*', '') AS number, regexp_replace(name, '^\s*(-\s*)+', '') AS dashes,
      regexp_replace(name, '[\s_-]+\d+\s*$', '') AS trailing FROM ({_N})""",
    "rnm02_whitespace": rf"SELECT id, regexp_replace(name, '\s+', ' ', 'g') AS collapsed, trim(name) AS trimmed FROM ({_N})",
    "rnm03_title_case": rf"""SELECT id, array_to_string(list_transform(regexp_extract_all(name, '\s+|\S+'), lambda w: CASE WHEN upper(w) IN ('DJ', 'BPM', 'FX', 'EQ', 'MIDI', 'TR', 'VEC', 'EDM') THEN upper(w)
      ELSE upper(w[1]) || lower(w[2:]) END), '') AS titled FROM ({_N})""",
    "rnm04_add_text": f"SELECT id, p_brand || '_' || name AS first, name || ' [Am]' AS last FROM ({_N})",
    "rnm05_replace": rf"""SELECT id, regexp_replace(name, '(?i)small', 'tiny', 'g') AS literal, name AS cased, regexp_replace(name, '(\w+) (ring|bolt)', '\2 \1', 'g') AS pattern FROM ({_N})""",
    "rnm06_remove": f"""SELECT id, replace(name, 'ring', '') AS anywhere, CASE WHEN prefix(name, ' -- ') THEN substr(name, 5) ELSE name END AS start,
      CASE WHEN suffix(name, ' 1') THEN substr(name, 1, length(name) - 2) ELSE name END AS end FROM ({_N})""",
    "rnm07_char_range": f"SELECT id, substr(name, 1, 2) || substr(name, 6) AS cut, substr(name, 1, 3) || substr(name, length(name)) AS swapped FROM ({_N})",
    "rnm08_pad": rf"SELECT id, CASE WHEN regexp_matches(name, '\D\d\s*$') THEN regexp_replace(name, '(\d)\s*$', '0\1') ELSE name END AS padded FROM ({_N})",
    "rnm09_tokens": f"SELECT id, lpad(CAST(p_size AS VARCHAR), 3, '0') || '-' || p_type || '-me-{{nope}}-1' AS text FROM ({_N})",
    "rnm10_category": f"""WITH b AS (SELECT *, CAST({_BEST} AS INT) AS category FROM ({_N})) SELECT id, category, CASE category WHEN 2 THEN 'small ring' WHEN 3 THEN 'anv'
      WHEN 0 THEN regexp_extract(p_name, '(bolt|ring|rod)') WHEN 1 THEN regexp_extract(p_name, '(gear|widget|gizmo)') END AS keyword FROM b""",
    "rnm11_affix": f"SELECT id, 'METAL - ' || name AS prefixed, CASE WHEN suffix(name, ' 1') THEN name ELSE name || ' 1' END AS suffixed FROM ({_N})",
    "rnm12_collisions": """WITH p AS (SELECT p_partkey AS id, p_brand, CASE WHEN p_size % 5 = 0 THEN upper(p_name) WHEN p_size % 11 = 0 THEN '' ELSE p_name END AS target FROM part),
      n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(target) ORDER BY id) - 1 AS n FROM p WHERE target <> '')
      SELECT id, CASE WHEN n = 0 THEN target ELSE target || '_' || n END AS final FROM n""",
    "rnm13_rule_tree": f"""WITH s AS (SELECT id, {_STEP3} AS c FROM ({_N})) SELECT id, c || CASE WHEN contains(lower(c), 'ring') THEN ' (r)' WHEN prefix(lower(c), 'small') THEN ' (s)' ELSE ' (-)' END AS current FROM s""",
    "rnm14_preview": f"""SELECT id, CAST(row_number() OVER (ORDER BY p_brand, name, id) AS INT) AS index, name AS original_name, {_STEP3} AS new_name, {_STEP3} <> name AS changed FROM ({_N})""",
    "rnm15_unique_folders": """WITH e AS (SELECT DISTINCT p_brand, CASE WHEN p_size % 4 = 0 THEN p_name ELSE p_name || ' (' || (p_size % 5 + 1) || ')' END AS f FROM part WHERE p_size % 6 = 0),
      n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part),
      s AS (SELECT p_brand, p_name, count(*) + 10 AS top FROM part GROUP BY 1, 2),
      c AS (SELECT p_brand, p_name, k, CASE WHEN k = 1 THEN p_name ELSE p_name || ' (' || k || ')' END AS f FROM (SELECT *, unnest(range(1, top)) AS k FROM s)),
      o AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY k) AS n FROM c ANTI JOIN e USING (p_brand, f))
      SELECT p_partkey AS id, f AS folder FROM n JOIN o USING (p_brand, p_name, n)""",
    "rnm16_sequence": """WITH n AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) + (SELECT max(c_custkey) FROM customer WHERE c_custkey % 10 = 7) AS n FROM part)
      SELECT id, 'song_' || CASE WHEN n >= 10000 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 4, '0') END AS name FROM n""",
    "rnm18_label_category": f"""SELECT p_partkey AS id, CASE WHEN contains(p_name, 'small ring') THEN 'Size' WHEN p_size % 2 = 0 THEN 'Machine' ELSE
      CASE {_BEST} WHEN 0 THEN 'Metal' WHEN 1 THEN 'Machine' WHEN 3 THEN 'Part' END END AS category FROM part""",
    "rnm19_prefix": f"SELECT id, CASE WHEN size % 2 = 0 THEN upper(category) ELSE '' END AS prefix, folder AS rest FROM ({FILES})",
    "flt01_conditions": """SELECT p_partkey AS id, contains(p_name, 'ring') AS contains, NOT contains(p_name, 'ring') AS not_contains, p_name = 'red ring' AS equals,
      regexp_matches(p_name, '^(red|small)') AS matches, false AS empty FROM part""",
    "flt02_condition_groups": """SELECT p_partkey AS id, contains(p_name, 'ring') AND contains(p_name, 'small') AS all_of, contains(p_name, 'ring') OR contains(p_name, 'small') AS any_of, false AS none FROM part""",
}
