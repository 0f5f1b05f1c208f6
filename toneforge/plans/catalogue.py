"""The catalogue of queries and, where SQL can express them, their SQL for another engine."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..functions.marks import LETTERS, MARKS, TONES, composed, plain, several
from ..operators import align, corpus, corruption, inventory, metrics, profile, smoke, split
from ..sources import files, runs

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _queries[fn.__name__] = fn
        if sql is not None:
            _sql[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL --------------------------------------------------------------------------------------------


def _base_sql(text: str = "text") -> str:
    own = composed()
    out = f"translate({text}, '{''.join(own)}đĐ', '{''.join(map(plain, own))}dD')"
    for ch, bare in several().items():
        out = f"replace({out}, '{ch}', '{bare}')"
    return f"regexp_replace({out}, '[{MARKS}]', '', 'g')"


def _with_marks(marks: str) -> str:
    """Composed letters that hold one of marks."""
    return "".join(ch for ch in map(chr, range(0xC0, 0x2000)) if ch.isalpha() and unicodedata.normalize("NFC", ch) == ch and any(m in marks for m in unicodedata.normalize("NFD", ch)))


def _toneless_sql(text: str = "text") -> str:
    pairs = {ch: unicodedata.normalize("NFC", "".join(m for m in unicodedata.normalize("NFD", ch) if m not in TONES)) for ch in _with_marks("".join(TONES))}
    pairs = {a: b for a, b in pairs.items() if len(b) == 1}
    return f"translate({text}, '{''.join(pairs)}', '{''.join(pairs.values())}')"


def _marked(good) -> str:
    """Composed letters and symbols whose marks satisfy good."""
    return "".join(ch for ch in map(chr, range(0xC0, 0x2000)) if unicodedata.normalize("NFC", ch) == ch and (d := unicodedata.normalize("NFD", ch)) != ch and good([m for m in d if unicodedata.combining(m)]))


_COMPOSED = _marked(lambda m: True)
#: Letters with a mark that is neither a tone's nor a letter's, or with several letter marks.
_ODD = _marked(lambda m: any(x not in MARKS for x in m) or sum(x in LETTERS for x in m) > 1)


def _canonical_sql(rows: str) -> str:
    """CTEs that end in canon (all columns of rows and canonical), for rows with doc_id and composed text. Every run of letters with one tone mark carries it on its nucleus: of the vowels around the mark, without the u of qu, the i of gi and a gliding o or u before them, the last with a letter mark, else the last before a consonant, else the first."""
    toned, shaped = _with_marks("".join(TONES)), _with_marks("".join(LETTERS))
    bare = {ch: unicodedata.normalize("NFC", "".join(m for m in unicodedata.normalize("NFD", ch) if m not in TONES)) for ch in toned}
    bare = {ch: x for ch, x in bare.items() if len(x) == 1}
    letters = [chr(p) for p in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x2000)) if chr(p).isalpha() and unicodedata.normalize("NFC", chr(p)) == chr(p)]
    put = []
    for mark in TONES:
        pairs = {c: x for c in letters if len(x := unicodedata.normalize("NFC", c + mark)) == 1}
        a, b = "".join(pairs), "".join(pairs.values())
        put.append(f"WHEN contains('{_with_marks(mark)}', old) THEN CASE WHEN contains('{a}', new) THEN translate(new, '{a}', '{b}') ELSE new || '{mark}' END")
    return (
        f"src AS (SELECT * FROM {rows}), parts AS (SELECT doc_id, unnest(l) AS r, unnest(range(len(l))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '\\p{{L}}+|[^\\p{{L}}]+') AS l FROM src)), "
        f"one AS (SELECT DISTINCT r, length(regexp_extract(r, '^[^{toned}]*')) AS t, lower(strip_accents(translate(r, 'đĐ', 'dD'))) AS s, regexp_replace(regexp_replace(r, '[^{shaped}]', '0', 'g'), '[^0]', '1', 'g') AS h FROM parts WHERE len(regexp_extract_all(r, '[{toned}]')) = 1), "
        "v0 AS (SELECT *, t - length(regexp_extract(left(s, t), '[aeiouy]*$')) AS a0, t + length(regexp_extract(substr(s, t + 1), '^[aeiouy]*')) AS e FROM one), "
        "v1 AS (SELECT *, a0 + (e - a0 > 1 AND a0 > 0 AND substr(s, a0, 2) IN ('qu', 'gi') AND substr(h, a0 + 1, 1) = '0')::INT AS a1 FROM v0 WHERE e > t), "
        "v2 AS (SELECT *, a1 + (e - a1 > 1 AND substr(h, a1 + 1, 1) = '0' AND substr(s, a1 + 1, 2) IN ('oa', 'oe', 'uy'))::INT AS a FROM v1), "
        "v3 AS (SELECT *, length(regexp_extract(substr(h, a + 1, e - a), '^.*1')) AS d FROM v2), "
        "v4 AS (SELECT *, CASE WHEN d > 0 THEN a + d - 1 WHEN e < length(s) THEN e - 1 ELSE a END AS n, substr(r, t + 1, 1) AS old FROM v3), "
        f"v5 AS (SELECT *, substr(r, n + 1, 1) AS new, translate(old, '{''.join(bare)}', '{''.join(bare.values())}') AS less FROM v4 WHERE n <> t), "
        f"v6 AS (SELECT r AS was, n, t, less, CASE {' '.join(put)} END AS more FROM v5), "
        "v7 AS (SELECT was, array_to_string([CASE WHEN i = t THEN less WHEN i = n THEN more ELSE substr(was, i + 1, 1) END FOR i IN range(length(was))], '') AS now FROM v6), "
        "canon AS (SELECT src.*, coalesce(c, text) AS canonical FROM src LEFT JOIN (SELECT doc_id AS i, string_agg(coalesce(now, r), '' ORDER BY k) AS c FROM parts LEFT JOIN v7 ON r = was GROUP BY doc_id) ON doc_id = i) "
    )


_WS = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_W = r"\p{L}\p{N}_"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_equivalent_by_lang(spark, sf_dir)


# --- base text ------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_base_sql()} AS base FROM documents")
def strip_base_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.strip_base(F.col("text")).alias("base"))


@query(f"SELECT doc_id, trim(regexp_replace({_base_sql()}, '[{_WS}]+', ' ', 'g')) AS signature FROM documents")
def base_signature_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.base_signature(F.col("text")).alias("signature"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (text = {_base_sql()}) AS base_equivalent FROM documents GROUP BY lang")
def base_equivalent_by_lang(spark, sf_dir):
    same = F.col("text") == T.strip_base(F.col("text"))
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(same).alias("base_equivalent"))


@query(f"SELECT doc_id, sha256({_base_sql()}) AS digest FROM documents")
def strip_to_base_documents(spark, sf_dir):
    """The kernel, on all documents; for composed text it agrees with the native expression."""
    return _docs(spark, sf_dir).select("doc_id", T.text_digest(T.strip_to_base(F.col("text"))).alias("digest"))


@query("WITH " + _canonical_sql("documents") + "SELECT doc_id, canonical FROM canon")
def canonical_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.canon(F.col("text")).alias("canonical"))


# Words with the mark on either vowel, with letter marks, onsets, glides, capitals, and none or several marks.
VIETNAMESE = (
    "hoà bình và thuỷ chung", "Hòa bình, thủy chung", "khoẻ mạnh; khỏe", "QUÝ giá, quí, quýt, quỳnh", "giếng gìn giữ già gió gịa", "tiếng Việt, nghiêng ngả, nguyễn", "đường phố Đà Nẵng", "loà xoà, lòe xòe, oằn oèo, toán hoán",
    "của cua múa mùa, mía mìa", "ủy ban uỷ ban huỷ hủy tuỳ tùy", "yêu yếu ý kiến", "thuở, huơ, khuỷu khuya", "ngoằn ngoèo ngoáy khoái", "rượu bưởi người", "café résumé élève Müller naïve", "xyz đ Đ 123 ... ", "Ôi! Ấy ơi ừ", "queo quẹo quèo quyển", "giết giặc giỏi gì", "bóoc xoong",
)
_VIETNAMESE_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(VIETNAMESE)) + ") v(doc_id, text))"


def _vietnamese(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(VIETNAMESE)), "doc_id int, text string")


@query("WITH " + _canonical_sql(_VIETNAMESE_SQL) + "SELECT doc_id, canonical FROM canon")
def canonical_vietnamese(spark, sf_dir):
    return _vietnamese(spark).select("doc_id", T.canon(F.col("text")).alias("canonical"))


@query("WITH " + _canonical_sql(_VIETNAMESE_SQL) + f"SELECT doc_id, {_base_sql('canonical')} AS base FROM canon")
def base_vietnamese(spark, sf_dir):
    return _vietnamese(spark).select("doc_id", T.strip_to_base(F.col("text")).alias("base"))


@query(
    "WITH " + _canonical_sql(_VIETNAMESE_SQL) + "SELECT doc_id, canonical <> text AS canon_changed, " + f"length(canonical)::INT AS total_units, len(regexp_extract_all(canonical, '\\p{{L}}+'))::INT AS syllables, "
    f"len(regexp_extract_all(canonical, '[{_with_marks(''.join(TONES))}]'))::INT AS with_tone, len(regexp_extract_all(canonical, '[{_with_marks(''.join(LETTERS))}đĐ]'))::INT AS with_letter FROM canon"
)
def orthography_vietnamese(spark, sf_dir):
    o = _vietnamese(spark).select("doc_id", T.observe_orthography(F.col("text")).alias("o"))
    return o.select("doc_id", "o.canon_changed", "o.total_units", "o.syllables", F.col("o.units_with_observed_tone").alias("with_tone"), F.col("o.units_with_observed_letter").alias("with_letter"))


@query("WITH " + _canonical_sql(_VIETNAMESE_SQL) + f"SELECT doc_id, {_toneless_sql('canonical')} AS p100, {_base_sql('canonical')} AS strip_all, canonical AS p0 FROM canon")
def corruption_vietnamese(spark, sf_dir):
    """The conditions that leave nothing to chance."""
    own = _vietnamese(spark).withColumn("sample_id", F.col("doc_id").cast("string"))
    out = own.select("doc_id", "sample_id", "text")
    for name, column in (("P100", "p100"), ("STRIP_ALL", "strip_all"), ("FULL", "p0")):
        out = corruption.corrupt(out, name, 42).withColumn(column, F.col("corruption.corrupted_text")).drop("corruption")
    return out.select("doc_id", "p100", "strip_all", "p0")


@query("WITH " + _canonical_sql("documents") + f"SELECT doc_id, canonical = text AS already_canonical, false AS nfc_changed, canonical <> text AS tone_placement_changed, length(text)::INT AS input_length, length(canonical)::INT AS canonical_length, CASE WHEN regexp_matches(text, '[{_COMPOSED}]') THEN 'NFC' ELSE 'NFC=NFD' END AS input_form, 'MODERN' AS placement FROM canon WHERE text IS NOT NULL")
def canonical_differences(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", T.canonical_differences(F.col("text")).alias("d")).select("doc_id", "d.*")


_ANY_MARK = _with_marks("".join(MARKS)) + "đĐ"


@query(
    "WITH " + _canonical_sql("documents") + f"SELECT lang, count(*) FILTER (canonical <> text) AS canon_changed, count(*) FILTER (canonical = {_base_sql('canonical')}) AS base_equivalent, sum(len(regexp_extract_all(canonical, '[{_ANY_MARK}]')))::BIGINT AS changed_characters, "
    f"sum(len(regexp_extract_all(canonical, '[{_ANY_MARK}]')))::BIGINT AS changed_units, sum(length(canonical))::BIGINT AS total_units, sum(len(regexp_extract_all(canonical, '\\p{{L}}+')))::BIGINT AS syllables, sum(len(regexp_extract_all(canonical, '\\p{{L}}')))::BIGINT AS letter_eligible_units, "
    f"sum(len(regexp_extract_all(canonical, '[{_with_marks(''.join(LETTERS))}đĐ]')))::BIGINT AS letter_observed_units FROM canon GROUP BY lang"
)
def orthography_by_lang(spark, sf_dir):
    seen = _docs(spark, sf_dir).select("lang", T.observe_orthography(F.col("text")).alias("o"))
    return seen.groupBy("lang").agg(F.count_if("o.canon_changed").alias("canon_changed"), F.count_if("o.base_equivalent").alias("base_equivalent"), *(F.sum(f"o.{c}").alias(c) for c in ("changed_characters", "changed_units", "total_units", "syllables", "letter_eligible_units", "letter_observed_units")))


@query(f"SELECT lang, sum(len(regexp_extract_all(text, '\\p{{L}}')))::BIGINT AS eligible, sum(len(regexp_extract_all(text, '[{_with_marks(''.join(LETTERS))}đĐ]')))::BIGINT AS observed FROM documents GROUP BY lang")
def letter_density_by_lang(spark, sf_dir):
    seen = _docs(spark, sf_dir).select("lang", T.observe_orthography(F.col("text")).alias("o"))
    return seen.groupBy("lang").agg(F.sum(F.col("o.letter_eligible_units").cast("long")).alias("eligible"), F.sum(F.col("o.letter_observed_units").cast("long")).alias("observed"))


@query(
    "WITH s AS (SELECT lang, unnest(regexp_extract_all(text, '\\p{L}+')) AS run FROM documents), t AS (SELECT lang, regexp_extract(run, '[" + _with_marks("".join(TONES)) + "]') AS c FROM s) "
    "SELECT lang, CASE " + " ".join(f"WHEN c <> '' AND contains('{_with_marks(m)}', c) THEN '{t}'" for m, t in TONES.items()) + " ELSE 'UNMARKED' END AS tone, count(*) AS syllables FROM t GROUP BY ALL"
)
def syllable_tone_counts(spark, sf_dir):
    each = _docs(spark, sf_dir).select("lang", F.explode(T.syllable_tones(F.col("text"))).alias("tone"))
    return each.groupBy("lang", "tone").agg(F.count("*").alias("syllables"))


@query(f"SELECT lang, CASE WHEN regexp_matches(text, '[{_COMPOSED}]') THEN 'NFC' ELSE 'NFC=NFD' END AS form, count(*) AS texts FROM documents GROUP BY ALL")
def unicode_forms(spark, sf_dir):
    return _docs(spark, sf_dir).select("lang", T.unicode_form(F.col("text")).alias("form")).groupBy("lang", "form").agg(F.count("*").alias("texts"))


@query(f"SELECT lang, sum(length(text))::BIGINT AS units, sum(len(regexp_extract_all(text, '\\p{{L}}+')))::BIGINT AS syllables FROM documents GROUP BY lang")
def units_by_lang(spark, sf_dir):
    seen = _docs(spark, sf_dir).select("lang", T.observe_orthography(F.col("text")).alias("o"))
    return seen.groupBy("lang").agg(F.sum(F.col("o.total_units").cast("long")).alias("units"), F.sum(F.col("o.syllables").cast("long")).alias("syllables"))


@query(
    "WITH u AS (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) SELECT lang, CASE " + " ".join(f"WHEN contains('{_with_marks(m)}', c) THEN '{t}'" for m, t in TONES.items()) + " ELSE 'UNMARKED' END AS tone, count(*) AS units FROM u WHERE c <> '' GROUP BY ALL"
)
def unit_rows_by_tone(spark, sf_dir):
    rows = T.unit_rows(_docs(spark, sf_dir), key="lang", fields=("observed_tone",))
    return rows.groupBy("lang", F.col("observed_tone").alias("tone")).agg(F.count("*").alias("units"))


@query("SELECT lang, count(*) AS syllables, sum(length(run))::BIGINT AS letters FROM (SELECT lang, unnest(regexp_extract_all(text, '\\p{L}+')) AS run FROM documents) GROUP BY lang")
def syllable_rows_by_lang(spark, sf_dir):
    rows = T.syllable_rows(_docs(spark, sf_dir), key="lang", fields=("base_start", "base_end"))
    return rows.groupBy("lang").agg(F.count("*").alias("syllables"), F.sum((F.col("base_end") - F.col("base_start")).cast("long")).alias("letters"))


@query(f"SELECT doc_id, sha256({_base_sql()}) AS digest FROM documents")
def base_pathway(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.text_digest(T.pathway_text(F.col("text"), "BASE_ONLY")).alias("digest"))


@query(f"SELECT doc_id, sha256(regexp_replace(replace(lower(trim(regexp_replace({_base_sql()}, '[{_WS}]+', ' ', 'g'))), 'ß', 'ss'), '[.!?… \t\r\n]+$', '')) AS digest FROM documents")
def rewrite_signatures(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.text_digest(T.rewrite_signature(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, CASE WHEN text = {_base_sql()} THEN NULL ELSE length(regexp_extract(text, '^[^{''.join(composed())}đĐ]*'))::INT END AS place FROM documents")
def divergence_from_base(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.first_divergence(F.col("text"), T.strip_base(F.col("text"))).alias("place"))


@query(f"SELECT doc_id, len([p for p in list_zip(string_split_regex(text, '[{_WS}]+'), string_split_regex({_base_sql()}, '[{_WS}]+')) if p[1] <> p[2]])::INT AS words FROM documents")
def words_changed_by_stripping(spark, sf_dir):
    """Words replaced one by one, so the changes' words are those that differ at their place."""
    changes = T.word_diff(F.col("text"), T.strip_base(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", F.aggregate(changes, F.lit(0), lambda n, c: n + F.size(c["before"])).alias("words"))


@query(f"SELECT CASE WHEN regexp_matches(text, '[{_COMPOSED}]') THEN 'NFC' ELSE 'NFC=NFD' END AS input_form, count(*) AS texts, 0::BIGINT AS failed, count(*) FILTER (regexp_matches(text, '[{_ODD}]')) AS anomalous FROM documents GROUP BY ALL")
def round_trip_summary(spark, sf_dir):
    return smoke.round_trip_summary(smoke.round_trip(_docs(spark, sf_dir).select("doc_id", "text")))


# --- duplicates, profiles -------------------------------------------------------------------------------------


def _grouped(spark, sf_dir, label, part, digest=T.text_digest):
    return profile.duplicates(_docs(spark, sf_dir), digest(F.col("text")), part, label, "doc_id", most=1)


_DUP = "SELECT sha256(text) AS digest, count(*) AS size, string_agg(DISTINCT {s}, ',' ORDER BY {s}) AS splits, string_agg(DISTINCT {l}, ',' ORDER BY {l}) AS labels, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1{more}"


def _flat(groups: DataFrame) -> DataFrame:
    return groups.select("digest", "size", F.array_join("splits", ",").alias("splits"), F.array_join("labels", ",").alias("labels"), F.col("sample_ids")[0].alias("first_id"))


@query(_DUP.format(s="source", l="lang", more=""))
def exact_duplicates(spark, sf_dir):
    return _flat(_grouped(spark, sf_dir, "lang", "source"))


@query("WITH " + _canonical_sql("documents") + "SELECT sha256(canonical) AS digest, count(*) AS size, string_agg(DISTINCT source, ',' ORDER BY source) AS splits, string_agg(DISTINCT lang, ',' ORDER BY lang) AS labels, min(doc_id) AS first_id FROM canon GROUP BY 1 HAVING count(*) > 1")
def canonical_duplicates(spark, sf_dir):
    return _flat(_grouped(spark, sf_dir, "lang", "source", T.canonical_digest))


@query(_DUP.format(s="lang", l="source", more=" AND count(DISTINCT source) > 1"))
def conflicting_label_groups(spark, sf_dir):
    return _flat(profile.conflicting(_grouped(spark, sf_dir, "source", "lang")))


@query(_DUP.format(s="source", l="lang", more=" AND count(DISTINCT source) > 1"))
def cross_split_groups(spark, sf_dir):
    return _flat(profile.cross_split(_grouped(spark, sf_dir, "lang", "source")))


@query("WITH g AS (SELECT sha256(text) AS d FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1) SELECT doc_id, source FROM documents WHERE sha256(text) NOT IN (SELECT d FROM g)")
def without_conflicting_groups(spark, sf_dir):
    return profile.without_conflicts(_docs(spark, sf_dir), T.text_digest(F.col("text")), "source").select("doc_id", "source")


@query("SELECT source, coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0)::BIGINT AS duplicate_excess, count(*) FILTER (n > 1) AS duplicate_groups FROM (SELECT source, sha256(text) AS d, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source")
def duplicate_excess(spark, sf_dir):
    return profile.excess(_docs(spark, sf_dir), T.text_digest(F.col("text")), ("source",))


_COUNT = "sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS {n}"
_DIGIT = f"[{_W}]*\\p{{Nd}}[{_W}]*"
_NOISE_SQL = (("urls", f"(?i)https?://[^{_WS}]+|www\\.[^{_WS}]+"), ("mentions", f"@[{_W}]+"), ("hashtags", f"#[{_W}]+"), ("emoji_or_symbols", r"[\x{10000}-\x{10FFFF}]|\p{So}|\p{Sk}"), ("digit_bearing_tokens", _DIGIT))


@query(
    "WITH " + _canonical_sql("documents") + ", own AS (SELECT * FROM canon WHERE trim(text) <> ''), "
    "l AS (SELECT split, sum(n)::BIGINT AS rows, '{' || string_agg('\"' || label || '\":' || n, ',' ORDER BY label) || '}' AS labels FROM (SELECT source AS split, lang AS label, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY split), "
    "runs AS (SELECT source, count(*) AS n FROM (SELECT source, doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS island FROM (SELECT source, doc_id, unnest(string_split(text, '')) AS c, unnest(range(len(text))) AS i FROM own) WHERE c <> chr(10)) GROUP BY source, doc_id, c, island HAVING count(*) >= 3), "
    "r AS (SELECT source, count(*) AS repeated_char_runs FROM runs GROUP BY source), "
    f"t AS (SELECT source, count(*) AS texts, count(*) FILTER (canonical <> text) AS canon_changed, count(*) FILTER (canonical = {_base_sql('canonical')}) AS base_equivalent, count(*) FILTER (regexp_matches(canonical, '[{_with_marks(''.join(TONES))}]')) AS with_tone, "
    f"count(*) FILTER (regexp_matches(canonical, '[{_with_marks(''.join(LETTERS))}đĐ]')) AS with_letter, sum(len(regexp_extract_all(canonical, '\\p{{L}}')))::BIGINT AS letter_eligible_units, sum(len(regexp_extract_all(canonical, '[{_with_marks(''.join(LETTERS))}đĐ]')))::BIGINT AS letter_observed_units, "
    + ", ".join(_COUNT.format(p=p, n=n) for n, p in _NOISE_SQL) + " FROM own GROUP BY source), "
    + ", ".join(f"{k} AS (SELECT source, coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0)::BIGINT AS {k}_duplicate_excess FROM (SELECT source, sha256({c}) AS d, count(*) AS n FROM own GROUP BY 1, 2) GROUP BY source)" for k, c in (("exact", "text"), ("canonical", "canonical"))).replace("canonical AS (", "canonical_ AS (")
    + ", g AS (SELECT source, count(*) FILTER (n > 1) AS conflicting_groups FROM (SELECT source, sha256(canonical) AS d, count(DISTINCT lang) AS n FROM own GROUP BY 1, 2) GROUP BY source) "
    "SELECT split, rows, labels, texts, canon_changed, base_equivalent, with_tone, with_letter, 0::BIGINT AS tone_eligible_syllables, 0::BIGINT AS tone_observed_syllables, letter_eligible_units, letter_observed_units, urls, mentions, hashtags, emoji_or_symbols, coalesce(repeated_char_runs, 0) AS repeated_char_runs, digit_bearing_tokens, "
    "exact_duplicate_excess, canonical_duplicate_excess, conflicting_groups, NULL::DOUBLE AS tone_density, letter_observed_units / nullif(letter_eligible_units, 0) AS letter_density FROM l LEFT JOIN t ON split = t.source LEFT JOIN r ON split = r.source LEFT JOIN exact ON split = exact.source LEFT JOIN canonical_ ON split = canonical_.source LEFT JOIN g ON split = g.source"
)
def split_profile(spark, sf_dir):
    return profile.profile(_docs(spark, sf_dir), "source", "text", "lang").withColumn("labels", F.to_json("labels"))


@query(
    "WITH runs AS (SELECT source, count(*) AS n FROM (SELECT source, doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS island FROM (SELECT source, doc_id, unnest(string_split(text, '')) AS c, unnest(range(len(text))) AS i FROM documents) WHERE c <> chr(10)) "
    "GROUP BY source, doc_id, c, island HAVING count(*) >= 3) , r AS (SELECT source, count(*) AS repeated_char_runs FROM (SELECT source FROM runs) GROUP BY source) "
    "SELECT d.source, " + ", ".join(_COUNT.format(p=p, n=n) for n, p in _NOISE_SQL)
    + ", coalesce(any_value(r.repeated_char_runs), 0) AS repeated_char_runs FROM documents d LEFT JOIN r ON d.source = r.source GROUP BY d.source"
)
def noise_by_source(spark, sf_dir):
    n = T.noise(F.col("text"))
    return _docs(spark, sf_dir).groupBy("source").agg(*(F.sum(n[k].cast("long")).alias(k) for k in T.NOISE))


_PCT = ", ".join(f"quantile_disc(length({{c}}), {q / 100})::DOUBLE AS p{q}" for q in profile.PERCENTILES)


@query(f"SELECT lang, count(*) AS count, min(length(text))::DOUBLE AS min, {_PCT.format(c='text')}, max(length(text))::DOUBLE AS max, avg(length(text)) AS mean FROM documents GROUP BY lang")
def char_length_distribution(spark, sf_dir):
    return profile.distribution(_docs(spark, sf_dir), F.length("text"), ("lang",))


@query("SELECT t AS threshold, avg((length(text) <= t)::INT) AS vanilla, avg((length(trim(text)) - length(replace(trim(text), ' ', '')) <= t)::INT) AS base, least(avg((length(text) <= t)::INT), avg((length(trim(text)) - length(replace(trim(text), ' ', '')) <= t)::INT)) AS joint, 1 - least(avg((length(text) <= t)::INT), avg((length(trim(text)) - length(replace(trim(text), ' ', '')) <= t)::INT)) AS overflow FROM documents, (VALUES (64), (128), (256)) v(t) GROUP BY t")
def length_coverage(spark, sf_dir):
    blanks = F.length(F.trim("text")) - F.length(F.replace(F.trim("text"), F.lit(" "), F.lit("")))
    return profile.length_coverage(_docs(spark, sf_dir), F.length("text"), blanks)


@query("SELECT doc_id, len(regexp_extract_all(text, '[^" + _WS + "]+'))::BIGINT AS chunks, coalesce(list_sum([length(x) for x in regexp_extract_all(text, '[^" + _WS + "]+')]), 0)::BIGINT AS characters, length(regexp_extract(text, '^[" + _WS + "]*'))::BIGINT AS first_start FROM documents WHERE regexp_matches(text, '[^" + _WS + "]')")
def whitespace_chunks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.whitespace_chunk_counts(F.col("text")).alias("c")).where("c.chunks > 0").select("doc_id", "c.*")


# --- corruption -----------------------------------------------------------------------------------------------


def _corrupted(spark, sf_dir, name):
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "text", F.col("doc_id").cast("string").alias("sample_id"))
    return corruption.count(docs, name, 42)


@query(f"SELECT doc_id, sha256({_toneless_sql()}) AS digest FROM documents")
def p100_corruption(spark, sf_dir):
    return _corrupted(spark, sf_dir, "P100").select("doc_id", T.text_digest(F.col("corruption.corrupted_text")).alias("digest"))


@query(f"SELECT doc_id, sha256({_toneless_sql()}) AS digest FROM documents")
def p100_native(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.text_digest(corruption.strip_tones(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, sha256({_base_sql()}) AS digest FROM documents")
def strip_all_corruption(spark, sf_dir):
    return _corrupted(spark, sf_dir, "STRIP_ALL").select("doc_id", T.text_digest(F.col("corruption.corrupted_text")).alias("digest"))


@query()
def p50_corruption(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.col("doc_id").cast("string").alias("sample_id"))
    c = corruption.count(docs, "p50", 42).select("doc_id", "corruption", corruption.rates(F.col("corruption")).alias("r"))
    return c.select("doc_id", "corruption.text_identity", "corruption.candidate_units", "corruption.selected_units", "corruption.modified_units", "r.*")


@query()
def corruption_grid(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("sample_id"), "text")
    return corruption.grid(docs, 42, decisions=False).groupBy("condition").agg(F.count("*").alias("texts"), F.sum("corruption.selected_units").alias("selected"), F.sum("corruption.modified_units").alias("modified"))


@query()
def rate_scope_draws(spark, sf_dir):
    item = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("#0"))
    return _docs(spark, sf_dir).select("doc_id", H.rate_column(35422, item, F.lit("0")).alias("rate"), H.scope_column(35422, item, F.lit("0")).alias("scope"))


# --- corpus ---------------------------------------------------------------------------------------------------

_SCREEN = "SELECT doc_id, source FROM documents WHERE source = 'src0' AND sha256(text) {} IN (SELECT sha256(text) FROM documents WHERE source <> 'src0')"


def _screened(spark, sf_dir, digest=T.text_digest):
    docs = _docs(spark, sf_dir)
    return corpus.screen(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), digest=digest)


@query(_SCREEN.format("NOT"))
def contamination_kept(spark, sf_dir):
    return _screened(spark, sf_dir)[0].select("doc_id", "source")


@query(_SCREEN.format(""))
def contamination_excluded(spark, sf_dir):
    return _screened(spark, sf_dir)[1].select("doc_id", "source")


@query("WITH " + _canonical_sql("documents") + "SELECT doc_id, source FROM canon WHERE source = 'src0' AND sha256(canonical) IN (SELECT sha256(canonical) FROM canon WHERE source <> 'src0')")
def contamination_excluded_canonical(spark, sf_dir):
    return _screened(spark, sf_dir, T.canonical_digest)[1].select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('stage1-split|51733|' || doc_id), doc_id) <= 200 THEN 'dev' ELSE 'train' END AS partition FROM documents")
def hash_partition_sha2(spark, sf_dir):
    return corpus.split_documents(_docs(spark, sf_dir), 200, 51733, "doc_id", native=True).select("doc_id", "partition")


@query()
def hash_partition(spark, sf_dir):
    return corpus.split_documents(_docs(spark, sf_dir), 200, 51733, "doc_id").select("doc_id", "partition")


def _chunked(spark, sf_dir):
    docs = corpus.split_documents(_docs(spark, sf_dir), 200, 51733, "doc_id", native=True)
    own = docs.where("text <> ''").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), "partition", F.col("source").alias("source_shard"))
    return corpus.chunk(own, lambda t: len(t.split()) + 2, lambda t: len(t.split()) + 4, 256)


#: At most 252 words, and white space beside them, fit: two and four more tokens are counted to a chunk.
_CHUNKS = (
    "WITH p AS (SELECT doc_id, text, source, CASE WHEN row_number() OVER (ORDER BY sha256('stage1-split|51733|' || doc_id), doc_id) <= 200 THEN 'dev' ELSE 'train' END AS partition FROM documents), "
    f"l AS (SELECT *, CASE WHEN regexp_matches(text, '[^{_WS}]') THEN regexp_extract_all(text, '[{_WS}]*(?:[^{_WS}]+[{_WS}]*){{1,252}}') ELSE [text] END AS parts FROM p WHERE text <> ''), "
    "c AS (SELECT doc_id, source, partition, k, parts[k + 1] AS text, coalesce(list_sum([length(x) for x in parts[1:k]]), 0) AS source_start FROM (SELECT *, unnest(range(len(parts))) AS k FROM l)), "
    f"n AS (SELECT *, len(regexp_extract_all(text, '[^{_WS}]+')) AS words FROM c) "
)


@query(
    _CHUNKS + "SELECT doc_id || '#' || k AS chunk_id, doc_id::VARCHAR AS document_id, partition, k::INT AS chunk_index, text, source_start::INT AS source_start, (source_start + length(text))::INT AS source_end, (words + 2)::INT AS reference_length, (words + 4)::INT AS base_length, source AS source_shard FROM n"
)
def chunk_documents(spark, sf_dir):
    return _chunked(spark, sf_dir)


@query(_CHUNKS + "SELECT partition, count(*) AS chunks, count(DISTINCT doc_id) AS parents, max(words + 2)::INT AS max_reference, max(words + 4)::INT AS max_base, sum(length(text))::BIGINT AS characters FROM n GROUP BY partition")
def chunk_manifest(spark, sf_dir):
    return corpus.manifest(_chunked(spark, sf_dir))


@query("SELECT sum(length(text))::BIGINT AS characters, count(*) AS documents FROM documents WHERE text <> ''")
def verified_chunks(spark, sf_dir):
    """All verifiers over all chunks, which raise where one fails; then what the chunks hold."""
    path = runs.scratch(spark, "chunks")
    _chunked(spark, sf_dir).write.parquet(path)
    chunks = spark.read.parquet(path)
    docs = _docs(spark, sf_dir).where("text <> ''").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"))
    corpus.verify_tiling(chunks, docs)
    corpus.verify_partitions(chunks)
    return chunks.agg(F.sum(F.length("text").cast("long")).alias("characters"), F.count_distinct("document_id").alias("documents"))


@query("SELECT source, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS digest FROM documents GROUP BY source")
def membership_digest(spark, sf_dir):
    return corpus.membership_digest(_docs(spark, sf_dir), "doc_id", ("source",))


@query("WITH o AS (SELECT v AS visit, doc_id::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY v ORDER BY sha256('stage1-order|7|' || v || '|' || doc_id), doc_id::VARCHAR) - 1 AS position FROM documents, range(3) r(v)) SELECT visit::INT AS visit, position, ((visit * (SELECT count(*) FROM documents) + position) // 64)::BIGINT AS batch, chunk_id FROM o")
def pass_order_sha2(spark, sf_dir):
    own = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"))
    return corpus.pass_order(own, 7, 3, 64, native=True)


@query()
def pass_order(spark, sf_dir):
    own = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"))
    return corpus.pass_order(own, 7, 3, 64)


@query(
    "WITH g AS (SELECT DISTINCT lang, sha256(text) AS d FROM documents), k AS (SELECT lang, d, row_number() OVER (PARTITION BY lang ORDER BY sha256('17486|' || d), d) AS k, count(*) OVER (PARTITION BY lang) AS n FROM g) "
    "SELECT doc_id, documents.lang, CASE WHEN k.k <= round_even(k.n * 0.8, 0) THEN 'train' ELSE 'validation' END AS part FROM documents JOIN k ON documents.lang = k.lang AND sha256(text) = k.d"
)
def stratified_split_sha2(spark, sf_dir):
    """A text of several languages is a group of each."""
    own = _docs(spark, sf_dir)
    return split.stratified(own, {"train": 0.8, "validation": 0.2}, 17486, T.text_digest(F.col("text")), "lang", native=True, mixed_groups=True).select("doc_id", "lang", "part")


@query()
def stratified_split(spark, sf_dir):
    """A text of several languages is a group of each, as in stratified_split_sha2."""
    own = _docs(spark, sf_dir)
    return split.stratified(own, {"train": 0.8, "validation": 0.2}, 17486, T.canonical_digest(F.col("text")), "lang", mixed_groups=True).select("doc_id", "lang", "part")


# --- inventory, regions ---------------------------------------------------------------------------------------

# A sample of forms for the demonstration queries.
FORMS = ("the", "of", "and", "de", "la", "der", "que", "un", "hoa", "toan")
_FORMS_SQL = ", ".join(f"('{f}')" for f in FORMS)


def _spans(spark, sf_dir):
    runs = F.explode(F.regexp_extract_all(T.strip_base(F.col("text")), F.lit(r"(\p{L}+)"), 1))
    return _docs(spark, sf_dir).select("lang", runs.alias("base_text"))


@query(f"WITH s AS (SELECT lang, unnest(regexp_extract_all({_base_sql()}, '\\p{{L}}+')) AS w FROM documents), i(f) AS (VALUES {_FORMS_SQL}) SELECT lang, CASE WHEN f IS NULL THEN 'NOT_APPLICABLE' ELSE 'VIETNAMESE_CANDIDATE' END AS eligibility, count(*) AS spans FROM s LEFT JOIN i ON lower(w) = f GROUP BY ALL")
def inventory_eligibility(spark, sf_dir):
    forms = spark.createDataFrame([(f,) for f in FORMS], "form string")
    return inventory.resolve(_spans(spark, sf_dir), forms).groupBy("lang", "eligibility").agg(F.count("*").alias("spans"))


_ENTRIES = ("hòa", "hoà", "hoa", "toán", "đi", " ", "Thuỷ", "thủy", "QUÝ", "quí", "giữ", "gìn", "khoẻ", "khỏe", "loà", "lòa", "xoè", "xòe")
_ENTRIES_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(_ENTRIES)) + ") v(doc_id, text) WHERE trim(text) <> '')"


@query(
    "WITH " + _canonical_sql(_ENTRIES_SQL) + f", s AS (SELECT canonical AS c, lower({_base_sql('canonical')}) AS s FROM canon) "
    "SELECT count(*)::INT AS raw, count(DISTINCT c)::INT AS unique_canonical, count(DISTINCT s)::INT AS unique_stripped, (count(DISTINCT c) - count(DISTINCT s))::INT AS collisions FROM s"
)
def inventory_statistics(spark, sf_dir):
    t = inventory.statistics(spark.createDataFrame([(x,) for x in _ENTRIES], "form string"))
    return t.select(*(F.col(c).cast("int").alias(c) for c in t.columns))


_PIECES = "(1, 0, 0, 3), (1, 1, 3, 6), (1, 2, 6, 9), (2, 0, 0, 2), (2, 1, 2, 5)"
_REGIONS = "(1, 0, 0, 4, 'VIETNAMESE_CANDIDATE'), (1, 1, 4, 5, 'NOT_APPLICABLE'), (1, 2, 5, 7, 'VIETNAMESE_CANDIDATE'), (1, 3, 7, 9, 'VIETNAMESE_CANDIDATE'), (2, 0, 0, 2, 'NOT_APPLICABLE'), (2, 1, 2, 4, 'VIETNAMESE_CANDIDATE'), (2, 2, 4, 5, 'UNDECIDED')"


@query(
    f"WITH p(doc_id, piece_index, a, b) AS (VALUES {_PIECES}), r(doc_id, region_index, s, e, el) AS (VALUES {_REGIONS}), m AS (SELECT p.doc_id, piece_index, count(region_index) AS contributions, count(DISTINCT region_index) FILTER (el = 'VIETNAMESE_CANDIDATE') AS n, min(region_index) FILTER (el = 'VIETNAMESE_CANDIDATE') AS one, bool_or(el = 'UNDECIDED') AS u FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND s < b AND a < e GROUP BY ALL) "
    "SELECT doc_id, piece_index, contributions, CASE WHEN u THEN 'UNRESOLVED' WHEN n = 0 THEN 'NOT_APPLICABLE' WHEN n = 1 THEN 'SINGLE_CANDIDATE' ELSE 'MULTI_CANDIDATE_AMBIGUOUS' END AS ownership, CASE WHEN n = 1 AND NOT u THEN one ELSE -1 END AS tone_region_index FROM m"
)
def region_overlay(spark, sf_dir):
    p = spark.sql(f"SELECT * FROM VALUES {_PIECES} AS t(doc_id, piece_index, global_start, global_end)")
    r = spark.sql(f"SELECT * FROM VALUES {_REGIONS} AS t(doc_id, region_index, start, end, eligibility)")
    return align.overlay(p, r).select("doc_id", "piece_index", "contributions", "ownership", F.coalesce("tone_region_index", F.lit(-1)).alias("tone_region_index"))


def _thirds(t: str) -> tuple[list[str], list[int]]:
    """A stand-in for a tokenizer: pieces of three characters, all but the last with the mark of continuation."""
    parts = [t[k : k + 3] for k in range(0, len(t), 3)]
    return [p + align.CONTINUED for p in parts[:-1]] + parts[-1:], [len(p) for p in parts]


def _based(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang", T.strip_base(F.col("text")).alias("text"))


def _aligned(spark, sf_dir):
    return align.align(align.tokenized(align.chunks(_based(spark, sf_dir)), _thirds), unknown_id=1)


_CHUNK_SQL = f"SELECT doc_id, unnest(regexp_extract_all({_base_sql()}, '[^{_WS}]+')) AS w FROM documents"


@query(f"SELECT 'ALIGNED' AS status, count(*) AS chunks, round(avg(ceil(length(w) / 3)), 9) AS mean_subwords, max(ceil(length(w) / 3))::INT AS max_subwords, count(*) FILTER (length(w) % 3 = 1) AS unknown_pieces FROM ({_CHUNK_SQL})")
def alignment_summary(spark, sf_dir):
    """Every chunk of every document aligned with its pieces; those of one character are the unknown ones here."""
    t = align.summarize_alignments(_aligned(spark, sf_dir))
    return t.select(F.coalesce("failure_reason", F.lit("ALIGNED")).alias("status"), "chunks", F.round("mean_subwords", 9).alias("mean_subwords"), "max_subwords", "unknown_pieces")


@query(f"SELECT doc_id, sum(length(w))::BIGINT AS characters, sum(ceil(length(w) / 3))::BIGINT AS pieces FROM ({_CHUNK_SQL}) GROUP BY doc_id")
def document_pieces(spark, sf_dir):
    p = align.pieces_of(_based(spark, sf_dir), _thirds, unknown_id=1, fields=("global_start", "global_end", "piece_index"))
    return p.groupBy("doc_id").agg(F.sum((F.col("global_end") - F.col("global_start")).cast("long")).alias("characters"), (F.max("piece_index") + 1).cast("long").alias("pieces"))


@query(
    f"WITH t AS (SELECT doc_id, lang, {_base_sql()} AS b FROM documents), "
    f"w AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS k FROM (SELECT doc_id, regexp_extract_all(b, '[{_WS}]+|[^{_WS}]+') AS l FROM t)), "
    "ws AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM w), "
    f"pc AS (SELECT doc_id, s + o AS pos, s * 2 + o // 3 AS piece, s + 3 * (o // 3) AS piece_start FROM (SELECT doc_id, s, unnest(range(length(x))) AS o FROM ws WHERE regexp_matches(x, '[^{_WS}]'))), "
    "r AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS k FROM (SELECT doc_id, regexp_extract_all(b, '\\p{L}+|[^\\p{L}]+') AS l FROM t)), "
    "rs AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM r), "
    f"rc AS (SELECT doc_id, s + o AS pos, k, own FROM (SELECT doc_id, s, k, lower(x) IN ({', '.join(repr(f) for f in FORMS)}) AS own, unnest(range(length(x))) AS o FROM rs)), "
    "m AS (SELECT pc.doc_id, piece_start, count(DISTINCT k) AS contributions, count(DISTINCT k) FILTER (own) AS n FROM pc JOIN rc ON pc.doc_id = rc.doc_id AND pc.pos = rc.pos GROUP BY ALL) "
    "SELECT lang, CASE WHEN n = 0 THEN 'NOT_APPLICABLE' WHEN n = 1 THEN 'SINGLE_CANDIDATE' ELSE 'MULTI_CANDIDATE_AMBIGUOUS' END AS ownership, count(*) AS pieces, sum(contributions)::BIGINT AS contributions FROM m JOIN documents d ON m.doc_id = d.doc_id GROUP BY ALL"
)
def document_overlay(spark, sf_dir):
    """Every piece of every document against the document's regions."""
    docs = _docs(spark, sf_dir).select("lang", "text", T.strip_base(F.col("text")).alias("base"))
    o = align.overlay_of(docs, _thirds, "base", keys=("lang",), inventory=frozenset(FORMS), fields=("ownership", "contributions"))
    return o.groupBy("lang", "ownership").agg(F.count("*").alias("pieces"), F.sum("contributions").alias("contributions"))


@query(f"SELECT p AS path, count(*) AS cases, count(*) FILTER (p = 'BASE' OR text = {_base_sql()}) AS invariant_cases FROM documents, (VALUES ('RAW'), ('BASE')) v(p) WHERE text IS NOT NULL GROUP BY p")
def grid_invariance_by_path(spark, sf_dir):
    """The words of each text whole and stripped, taken as they are or stripped first."""
    base, text = T.strip_base(F.col("text")), F.col("text")
    rows = [(p, c, base if p == "BASE" or c == "STRIP_ALL" else text) for p in ("RAW", "BASE") for c in ("FULL", "STRIP_ALL")]
    seen = _docs(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("case_id"), F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(c).alias("condition"), F.split(t, " ").alias("tokens")) for p, c, t in rows))).alias("o"))
    return align.path_summary(seen.select("case_id", "o.*")).drop("mean_tokens")


@query("SELECT doc_id, (len(regexp_extract_all(text, '\\p{L}+')) + len(regexp_extract_all(text, '[^\\p{L}]+')))::BIGINT AS regions, len(regexp_extract_all(text, '\\p{L}+'))::BIGINT AS syllables, length(text)::INT AS characters FROM documents WHERE text <> ''")
def document_regions(spark, sf_dir):
    return align.regions(_docs(spark, sf_dir), fields=("end", "is_syllable")).groupBy("doc_id").agg(F.count("*").alias("regions"), F.count_if("is_syllable").alias("syllables"), F.max("end").alias("characters"))


_OFFSETS = "('a', 'xin chao', 0, 'xin', 0, 3, false), ('a', 'xin chao', 1, 'chao', 4, 8, false), ('b', 'xin', 0, 'x@@', 0, 1, false), ('b', 'xin', 1, 'ni', 1, 3, false), ('c', 'xin', 0, 'x', 0, 2, false), ('c', 'xin', 1, 'in', 1, 3, false), ('d', 'xin', 0, 'xin', NULL, NULL, false), ('e', 'xin', 0, '<s>', 0, 0, true)"


@query("SELECT * FROM (VALUES ('a', 'NATIVE_EXACT', 7::BIGINT), ('b', 'NATIVE_INEXACT', 3), ('c', 'NATIVE_MALFORMED', 3), ('d', 'ABSENT', 0), ('e', 'NOT_PROBED', 0)) t(case_id, availability, covered_characters)")
def offset_validation(spark, sf_dir):
    t = spark.sql(f"SELECT * FROM VALUES {_OFFSETS} AS t(case_id, text, index, token, start, end, is_special)")
    c = align.coverage(t).select(F.col("case_id").alias("c"), F.col("covered_characters").cast("long").alias("covered_characters"))
    return align.validate_offsets(t).join(c, F.col("case_id") == F.col("c")).select("case_id", "availability", "covered_characters")


# --- sources --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents")
def parquet_projection(spark, sf_dir):
    return files.parquet_columns(spark, f"{sf_dir}/documents.parquet", ("doc_id", "lang"))


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND trim(text) <> '' GROUP BY source")
def checked_rows(spark, sf_dir):
    own = _docs(spark, sf_dir).where("doc_id is not null and trim(text) <> ''")
    return corpus.check_rows(own, "doc_id", "text").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT source_shard, count(*) AS n FROM (SELECT lang AS source_shard FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')) GROUP BY source_shard")
def shards_united(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    whole = corpus.union_shards({lang: docs.where(F.col("lang") == lang) for lang in ("en", "de", "fr", "es")}, "doc_id")
    return whole.groupBy("source_shard").agg(F.count("*").alias("n"))


_AGAIN = "SELECT doc_id::VARCHAR AS sample_id, lang AS label, sha256(text) AS digest FROM documents WHERE text <> ''"


def _again(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "label", T.text_digest(F.col("text")).alias("digest"))


def _samples(spark, sf_dir):
    return _docs(spark, sf_dir).where("text <> ''").select(F.col("doc_id").cast("string").alias("sample_id"), "text", F.col("lang").alias("label"))


@query(_AGAIN)
def jsonl_again(spark, sf_dir):
    path = runs.scratch(spark, "jsonl")
    files.write_jsonl(_samples(spark, sf_dir), path)
    return _again(files.jsonl(spark, path, "sample_id string, text string, label string"))


@query(_AGAIN)
def csv_again(spark, sf_dir):
    path = runs.scratch(spark, "csv") + ".csv"
    _samples(spark, sf_dir).write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return _again(files.delimited(spark, path, "text", "label", "sample_id"))


@query(_AGAIN)
def written_once(spark, sf_dir):
    path = runs.scratch(spark, "once")
    files.write_once(_samples(spark, sf_dir), path, lambda df: corpus.check_rows(df, "sample_id", "text"))
    return _again(spark.read.parquet(path))


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE text <> ''")
def ids_again(spark, sf_dir):
    own, path = _samples(spark, sf_dir), runs.scratch(spark, "ids")
    files.write_ids(own, path, "sample_id")
    return files.read_ids(spark, path, corpus.membership_digest(own, "sample_id").first()["digest"])


@query("WITH l AS (SELECT unnest(string_split(text, chr(10))) AS t FROM documents) SELECT count(*) AS lines, sum(length(t))::BIGINT AS characters FROM l WHERE t <> ''")
def text_lines(spark, sf_dir):
    path = runs.scratch(spark, "lines")
    _docs(spark, sf_dir).where("text is not null").select("text").write.text(path)
    return files.lines(spark, path).agg(F.count("*").alias("lines"), F.sum(F.length("text").cast("long")).alias("characters"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text <> ''")
def first_text_column(spark, sf_dir):
    when = lambda *langs: F.when(F.col("lang").isin(*langs), F.col("text"))
    own = _docs(spark, sf_dir).where("text <> ''").select("doc_id", when("en").alias("a"), F.when(F.col("lang") == "de", F.col("text")).otherwise("").alias("sentence"), F.col("text").alias("content"))
    return files.first_present(own.withColumnRenamed("a", "text")).select("doc_id", T.text_digest(F.col("text")).alias("digest"))


# --- sets, draws ----------------------------------------------------------------------------------------------


@query("SELECT source, sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def first_of_each_text(spark, sf_dir):
    own = _docs(spark, sf_dir).select("source", T.text_digest(F.col("text")).alias("digest"), "doc_id")
    return corpus.keep_first(own, ("source", "digest"), ("doc_id",))


@query("WITH p AS (SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1), d AS (SELECT doc_id, count(*) AS m FROM p GROUP BY 1), b AS (SELECT documents.doc_id AS i, d.doc_id AS j, m FROM documents FULL JOIN d ON documents.doc_id = d.doc_id) SELECT count(i) AS inputs, sum(m)::BIGINT AS emitted, count(*) FILTER (m > 1) AS repeated, count(*) FILTER (m > 1) AS shared, count(*) FILTER (j IS NULL) AS missing, count(*) FILTER (i IS NULL) AS extra FROM b")
def label_coverage(spark, sf_dir):
    """How the labelled documents, good ones and toxic ones, cover all documents."""
    labels = _table(spark, sf_dir, "labels")
    parts = labels.where("quality = 1").select("doc_id", F.lit("good").alias("part")).union(labels.where("toxic = 1").select("doc_id", F.lit("toxic").alias("part")))
    return split.coverage(_docs(spark, sf_dir), parts, "doc_id")


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(sha256('b2|7|' || doc_id), 1, 8))::BIGINT / 4294967296 < 0.25")
def selected_documents(spark, sf_dir):
    draw = F.conv(F.substring(H.rank_key_sha2("b2", 7, F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") / F.lit(2**32)
    return _docs(spark, sf_dir).where(H.is_selected(draw, 0.25)).select("doc_id")


@query("SELECT i::INT AS place, ('0x' || substr(sha256('seeds'), 4 * i + 1, 4))::INT AS seed FROM range(5) r(i)")
def derived_seeds(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(H.derive_seeds("seeds", 5))), "place int, seed int")


@query("SELECT count(*) AS n, round(avg(quality - toxic), 9) AS mean, round(stddev_samp(quality - toxic), 9) AS deviation FROM labels")
def paired_labels(spark, sf_dir):
    own = _table(spark, sf_dir, "labels")
    both = metrics.paired_difference(own.select("doc_id", F.col("quality").alias("v")), own.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")
    return both.select("n", F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"))


@query("SELECT lang, max(length(text)) AS worst FROM documents GROUP BY lang")
def longest_by_lang(spark, sf_dir):
    return metrics.worst_case(_docs(spark, sf_dir).select("lang", F.length("text").cast("long").alias("score")), "lang")


@query("SELECT lang, count(*) AS n FROM documents WHERE length(text) <= 2000 GROUP BY lang")
def untruncated_documents(spark, sf_dir):
    return smoke.truncation(_docs(spark, sf_dir), F.length("text"), 2000, "SKIP").groupBy("lang").agg(F.count("*").alias("n"))


@query(f"SELECT lang AS category, count(*) AS cases, count(text) AS succeeded, round(avg((text = {_base_sql()})::INT), 9) AS clean_exact_rate, 1.0::DOUBLE AS base_preserved_rate, 1.0::DOUBLE AS deterministic_rate FROM documents GROUP BY lang")
def restoration_summary(spark, sf_dir):
    """Stripping taken for a restorer: the base stays, the text stays where it has no marks."""
    cases = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), "text", T.strip_base(F.col("text")).alias("output"), T.strip_base(F.col("text")).alias("repeat"), F.lit(1.0).alias("seconds"), F.lit(None).cast("string").alias("error"))
    t = smoke.summarize(smoke.records(cases)).where("category is not null")
    return t.select("category", "cases", "succeeded", F.round("clean_exact_rate", 9).alias("clean_exact_rate"), "base_preserved_rate", "deterministic_rate")


# --- metrics, selection ---------------------------------------------------------------------------------------


def _judged(spark, sf_dir):
    return _table(spark, sf_dir, "labels").select(F.col("toxic").alias("prediction"), F.col("quality").alias("label"))


_CLASS = "WITH c(label) AS (SELECT quality FROM labels UNION SELECT toxic FROM labels), t AS (SELECT label, count(*) FILTER (quality = label) AS support, count(*) FILTER (quality = label AND toxic = label) AS true_positive, count(*) FILTER (toxic = label AND quality <> label) AS false_positive, count(*) FILTER (quality = label AND toxic <> label) AS false_negative FROM labels, c GROUP BY label), m AS (SELECT *, coalesce(true_positive / nullif(true_positive + false_positive, 0), 0) AS precision, coalesce(true_positive / nullif(support, 0), 0) AS recall FROM t) "


@query(_CLASS + "SELECT label, support, true_positive, false_positive, false_negative, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM m")
def classification_report(spark, sf_dir):
    t = metrics.class_scores(_judged(spark, sf_dir))
    return t.select("label", "support", "true_positive", "false_positive", "false_negative", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(_CLASS + "SELECT round(avg(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)), 9) AS macro_f1 FROM m")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(_judged(spark, sf_dir)).select(F.round("macro_f1", 9).alias("macro_f1"))


@query("SELECT round(avg((quality = toxic)::INT), 9) AS accuracy, count(*) AS n FROM labels")
def accuracy(spark, sf_dir):
    return metrics.accuracy(_judged(spark, sf_dir)).select(F.round("accuracy", 9).alias("accuracy"), "n")


_GRR = "(72.0, 60.0, 84.0), (48.0, 60.0, 84.0), (70.0, 60.0, 60.0)"


@query(f"SELECT s, f, u, (s - f) / nullif(u - f, 0) AS recovery FROM (VALUES {_GRR}) t(s, f, u)".replace("(72.0, 60.0, 84.0)", "(72.0::DOUBLE, 60.0::DOUBLE, 84.0::DOUBLE)"))
def gap_recovery(spark, sf_dir):
    t = spark.createDataFrame([(72.0, 60.0, 84.0), (48.0, 60.0, 84.0), (70.0, 60.0, 60.0)], "s double, f double, u double")
    return t.withColumn("recovery", metrics.gap_recovery_column(F.col("s"), F.col("f"), F.col("u")))


_POINTS = "(500, 0.4, 0.2), (1000, 0.3, 0.1), (1500, 0.3, 0.1), (2000, 0.3, 0.2)"


@query(f"SELECT u AS update, s::DOUBLE AS score, d::DOUBLE AS d_clean FROM (VALUES {_POINTS}) t(u, s, d) ORDER BY s, d, u LIMIT 1")
def select_checkpoint(spark, sf_dir):
    t = spark.createDataFrame([(500, 0.4, 0.2), (1000, 0.3, 0.1), (1500, 0.3, 0.1), (2000, 0.3, 0.2)], "update int, score double, d_clean double")
    return metrics.best_checkpoint(t)


@query("SELECT e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def cosine_distances(spark, sf_dir):
    """Distances to one stated vector, a single row."""
    e = _table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(metrics.cosine_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))  # q is one row


@query("SELECT quality AS part, count(*) AS n, round(stddev_samp(toxic), 9) AS deviation FROM labels GROUP BY quality")
def label_deviation(spark, sf_dir):
    return _table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("part")).agg(F.count("*").alias("n"), F.round(metrics.sample_deviation(F.col("toxic")), 9).alias("deviation"))


@query("SELECT role, count(*) AS turns, sum(len(regexp_extract_all(text, '[^" + _WS + "]+')))::BIGINT AS chunks FROM conversations GROUP BY role")
def conversation_chunks(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations").select("role", F.size(T.whitespace_chunks(F.col("text"))).alias("n"))
    return t.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.col("n").cast("long")).alias("chunks"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)https?://[^" + _WS + "]+|www\\.[^" + _WS + "]+'))::INT AS urls, len(regexp_extract_all(html, '#[" + _W + "]+'))::INT AS hashtags FROM pages")
def page_noise(spark, sf_dir):
    n = T.noise(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", n["urls"].alias("urls"), n["hashtags"].alias("hashtags"))
