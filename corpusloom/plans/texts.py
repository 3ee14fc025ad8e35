"""Queries over texts: scalars, quality rules, duplicates, n-grams, distances, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DOCUMENTS, Quality
from ..functions import text as T
from ..operators import ngrams, rules
from .base import query

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
NORM = r"""trim(regexp_replace(regexp_replace(lower(translate(text, '‘’“”–—', '''''""--')), '[^a-z0-9'' \x{00C0}-\x{024F}]+', ' ', 'g'), '\s+', ' ', 'g'))"""
TOKENS = "list_filter(string_split({0}, ' '), lambda x: x <> '')"
DOC = f"WITH d AS (SELECT *, {NORM} AS norm FROM documents), w AS (SELECT *, {TOKENS.format('norm')} AS tok FROM d)"


def english(c: str = "text") -> Column:
    return T.normalize(F.col(c), "english")


@query("SELECT doc_id, translate(text, '‘’“”–—', '''''\"\"--') AS text FROM documents")
def normalize_punct(t):
    """X1"""
    return t("documents").select("doc_id", T.normalize_punct(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {NORM} AS text FROM documents")
def normalize_english(t):
    """X2"""
    return t("documents").select("doc_id", english().alias("text"))


NORM_TAGS = NORM.replace("translate(text,", r"translate(regexp_replace(regexp_replace(regexp_replace(text, '(https?://\S+|www\.\S+)', ' ', 'g'), '^\s*[A-Z0-9_]{2,20}:\s*', ''), '\[[^\]]*\]|\([^\)]*\)|<[^>]*>', ' ', 'g'),")


@query(f"SELECT doc_id, {NORM_TAGS} AS text FROM documents")
def normalize_tagged(t):
    """X2 with URLs, speaker tags and bracketed notes removed."""
    return t("documents").select("doc_id", T.normalize(F.col("text"), "english", strip_bracketed=True, strip_speaker=True, remove_urls=True).alias("text"))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), '’‘`', ''''''''), '[^a-z''\s]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM documents")
def char_normalize(t):
    """X14, X15"""
    return t("documents").select("doc_id", T.char_normalize(F.col("text")).alias("text"))


def _sql_lang(es: str, other: str) -> str:
    n = lambda cls: f"length(regexp_replace(text, '[^{cls}]', '', 'g'))"
    return (
        f"SELECT doc_id, CASE WHEN regexp_matches(text, '[{T.ARABIC}]') THEN 'arabic' WHEN regexp_matches(text, '[{T.CJK}]') THEN 'chinese' WHEN regexp_matches(text, '[{T.GREEK}]') THEN 'greek' "
        f"WHEN NOT regexp_matches(text, '[{T.LATIN}]') THEN '{other}' WHEN {n(es)} > {n(T.FRENCH)} THEN 'spanish' WHEN {n(T.FRENCH)} > 0 THEN 'french' ELSE 'english' END AS language FROM documents"
    )


@query(_sql_lang(T.SPANISH + T.INVERTED, "unknown"))
def detect_language(t):
    """X4"""
    return t("documents").select("doc_id", T.detect_language(F.col("text"), True, "unknown").alias("language"))


@query(_sql_lang(T.SPANISH, "auto"))
def detect_language_cleaning(t):
    """X3"""
    return t("documents").select("doc_id", T.detect_language(F.col("text"), False, "auto").alias("language"))


def ratios(raw: Column) -> dict[str, Column]:
    s = F.trim(raw)
    n = F.greatest(F.lit(1), F.length(s))
    alpha, digit = T.count_class(s, r"\p{L}"), T.count_class(s, r"\p{Nd}")
    alnum = T.count_class(s, r"\p{L}\p{N}")
    return {"alpha_ratio": alpha / n, "digit_ratio": digit / n, "non_alnum_ratio": 1 - alnum / n}


SQL_RATIOS = r"""length(regexp_replace(trim(text), '[^\p{L}]', '', 'g')) / greatest(1, length(trim(text))) AS alpha_ratio,
 length(regexp_replace(trim(text), '[^\p{Nd}]', '', 'g')) / greatest(1, length(trim(text))) AS digit_ratio,
 1 - length(regexp_replace(trim(text), '[^\p{L}\p{N}]', '', 'g')) / greatest(1, length(trim(text))) AS non_alnum_ratio"""


@query(f"SELECT doc_id, round(alpha_ratio, 6) AS alpha_ratio, round(digit_ratio, 6) AS digit_ratio, round(non_alnum_ratio, 6) AS non_alnum_ratio FROM (SELECT doc_id, {SQL_RATIOS} FROM documents)")
def char_ratios(t):
    """X6"""
    return t("documents").select("doc_id", *[F.round(c, 6).alias(n) for n, c in ratios(F.col("text")).items()])


def stats(df: DataFrame) -> DataFrame:
    """The quality statistics of each text."""
    x = df.withColumn("norm", english()).withColumn("tok", T.tokens(F.col("norm")))
    size = F.size("tok")
    lengths = F.transform("tok", F.length)
    return x.withColumns({
        "token_count": size.cast("long"), "char_count": F.length("norm").cast("long"), **ratios(F.col("text")),
        "max_repeat_run": T.longest_run(F.col("norm")).cast("long"),
        "unique_token_ratio": F.when(size > 0, F.size(F.array_distinct("tok")) / size).otherwise(0.0),
        "max_token_length": F.coalesce(F.array_max(lengths), F.lit(0)).cast("long"),
        "avg_token_length": F.when(size > 0, F.aggregate(lengths, F.lit(0), lambda a, v: a + v) / size).otherwise(0.0),
    })


def sql_stats(with_run: bool = True) -> str:
    run = ", ch AS (SELECT doc_id, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM (SELECT doc_id, string_split(norm, '') AS cs FROM d WHERE norm <> '')), nb AS (SELECT doc_id, i, CASE WHEN c = lag(c) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM ch), gr AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM nb), runs AS (SELECT doc_id, max(n) AS max_repeat_run FROM (SELECT doc_id, count(*) AS n FROM gr GROUP BY doc_id, g) GROUP BY doc_id)"
    return f"""{DOC}{run if with_run else ''}, s AS (SELECT w.doc_id, norm, tok, w.source, CAST(len(tok) AS BIGINT) AS token_count, CAST(length(norm) AS BIGINT) AS char_count, {SQL_RATIOS},
 {'CAST(coalesce(max_repeat_run, 0) AS BIGINT)' if with_run else '0'} AS max_repeat_run,
 CASE WHEN len(tok) > 0 THEN len(list_distinct(tok)) / len(tok) ELSE 0.0 END AS unique_token_ratio,
 CAST(coalesce(list_max(list_transform(tok, lambda x: length(x))), 0) AS BIGINT) AS max_token_length,
 CASE WHEN len(tok) > 0 THEN list_sum(list_transform(tok, lambda x: length(x))) / len(tok) ELSE 0.0 END AS avg_token_length
 FROM w {'LEFT JOIN runs USING (doc_id)' if with_run else ''})"""


STATS = ["token_count", "char_count", "alpha_ratio", "digit_ratio", "non_alnum_ratio", "max_repeat_run", "unique_token_ratio", "max_token_length", "avg_token_length"]
ROUNDED = ", ".join(f"round({s}, 6) AS {s}" if s.endswith(("ratio", "avg_token_length")) else s for s in STATS)


@query(f"{sql_stats()} SELECT doc_id, {ROUNDED} FROM s")
def quality_stats(t):
    """X5-X7, W17, D12"""
    return stats(t("documents")).select("doc_id", *[F.round(s, 6).alias(s) if s.endswith(("ratio", "avg_token_length")) else F.col(s) for s in STATS])


@query(f"{sql_stats()} SELECT doc_id, max_repeat_run FROM s")
def max_repeat_run(t):
    """W17"""
    return t("documents").select("doc_id", T.longest_run(english()).cast("long").alias("max_repeat_run"))


@query(f"{DOC} SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tok)) AS BIGINT) AS n_distinct, coalesce(tok[1], '') AS first_token FROM w")
def token_stats(t):
    """X5, X7"""
    x = t("documents").withColumn("tok", T.tokens(english()))
    return x.select("doc_id", F.size("tok").cast("long").alias("n_tokens"), F.size(F.array_distinct("tok")).cast("long").alias("n_distinct"), F.coalesce(F.get("tok", F.lit(0)), F.lit("")).alias("first_token"))


def quality_rules(q: Quality) -> rules.Rules:
    c = F.col
    return [
        ("min_tokens", c("token_count") < q.min_tokens), ("max_tokens", c("token_count") > q.max_tokens), ("min_chars", c("char_count") < q.min_chars), ("max_chars", c("char_count") > q.max_chars),
        ("max_token_length", c("max_token_length") > q.max_token_length), ("alpha_ratio", c("alpha_ratio") < q.min_alpha), ("digit_ratio", c("digit_ratio") > q.max_digit),
        ("non_alnum_ratio", c("non_alnum_ratio") > q.max_non_alnum), ("repeat_char", c("max_repeat_run") > q.max_repeat), ("unique_token_ratio", c("unique_token_ratio") < q.min_unique),
    ]


def sql_reasons(q: Quality) -> str:
    return f"""list_filter([CASE WHEN token_count < {q.min_tokens} THEN 'min_tokens' END, CASE WHEN token_count > {q.max_tokens} THEN 'max_tokens' END, CASE WHEN char_count < {q.min_chars} THEN 'min_chars' END,
 CASE WHEN char_count > {q.max_chars} THEN 'max_chars' END, CASE WHEN max_token_length > {q.max_token_length} THEN 'max_token_length' END, CASE WHEN alpha_ratio < {q.min_alpha} THEN 'alpha_ratio' END,
 CASE WHEN digit_ratio > {q.max_digit} THEN 'digit_ratio' END, CASE WHEN non_alnum_ratio > {q.max_non_alnum} THEN 'non_alnum_ratio' END, CASE WHEN max_repeat_run > {q.max_repeat} THEN 'repeat_char' END,
 CASE WHEN unique_token_ratio < {q.min_unique} THEN 'unique_token_ratio' END], lambda x: x IS NOT NULL)"""


def reasoned(df: DataFrame, q: Quality) -> DataFrame:
    return stats(df).withColumn("reasons", rules.all_reasons(quality_rules(q)))


@query(f"{sql_stats()} SELECT doc_id, array_to_string({sql_reasons(Quality())}, ';') AS reasons FROM s")
def quality_all_reasons(t):
    """F1 with the reference's thresholds."""
    return reasoned(t("documents"), Quality()).select("doc_id", F.array_join("reasons", ";").alias("reasons"))


@query(f"{sql_stats()}, r AS (SELECT unnest({sql_reasons(Quality())}) AS reason FROM s) SELECT reason, count(*) AS n FROM r GROUP BY reason ORDER BY n DESC, reason LIMIT 20")
def quality_reason_counts(t):
    """A3 over F1: the flagship query."""
    return reasoned(t("documents"), Quality()).select(F.explode_outer("reasons").alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(20)


@query(f"""{sql_stats()}, r AS (SELECT *, len({sql_reasons(DOCUMENTS)}) = 0 AS kept FROM s)
SELECT kept, count(*) AS n, round(avg(token_count), 6) AS avg_tokens, round(avg(char_count), 6) AS avg_chars, round(avg(alpha_ratio), 6) AS avg_alpha, round(avg(unique_token_ratio), 6) AS avg_unique, round(avg(max_repeat_run), 6) AS avg_run FROM r GROUP BY kept""")
def quality_summary(t):
    """A1 at document scale."""
    x = reasoned(t("documents"), DOCUMENTS).withColumn("kept", F.size("reasons") == 0)
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return x.groupBy("kept").agg(F.count("*").alias("n"), mean("token_count", "avg_tokens"), mean("char_count", "avg_chars"), mean("alpha_ratio", "avg_alpha"), mean("unique_token_ratio", "avg_unique"), mean("max_repeat_run", "avg_run"))


@query(f"{DOC} SELECT doc_id, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS ordinal, row_number() OVER (PARTITION BY norm ORDER BY doc_id) > 1 AND norm <> '' AS duplicate FROM d")
def duplicate_ordinal(t):
    """Occurrence number of a cleaned text; the hash stands for the text in the shuffle."""
    x = t("documents").select("doc_id", english().alias("norm"))
    x = x.select("doc_id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("key"), (F.col("norm") == "").alias("empty"))
    n = F.row_number().over(Window.partitionBy("h", "key").orderBy("doc_id"))
    return x.select("doc_id", n.alias("ordinal"), ((n > 1) & ~F.col("empty")).alias("duplicate"))


@query(f"""{sql_stats()}, r AS (SELECT *, len({sql_reasons(DOCUMENTS)}) > 0 AS failed, row_number() OVER (PARTITION BY norm ORDER BY doc_id) > 1 AND norm <> '' AS dup, norm <> (SELECT trim(text) FROM documents x WHERE x.doc_id = s.doc_id) AS changed FROM s)
SELECT count(*) AS total, count(*) FILTER (NOT failed AND NOT dup) AS kept, count(*) FILTER (failed) AS filtered, count(*) FILTER (dup) AS duplicates, count(*) FILTER (changed) AS changed, CAST(sum(token_count) AS BIGINT) AS tokens FROM r""")
def cleaning_report(t):
    """A2"""
    x = reasoned(t("documents"), DOCUMENTS)
    n = F.row_number().over(Window.partitionBy(F.xxhash64("norm"), F.sha2("norm", 256)).orderBy("doc_id"))
    x = x.select("token_count", (F.size("reasons") > 0).alias("failed"), ((n > 1) & (F.col("norm") != "")).alias("dup"), (F.col("norm") != F.trim("text")).alias("changed"))
    return x.agg(F.count("*").alias("total"), F.count_if(~F.col("failed") & ~F.col("dup")).alias("kept"), F.count_if("failed").alias("filtered"), F.count_if("dup").alias("duplicates"), F.count_if("changed").alias("changed"), F.sum("token_count").alias("tokens"))


@query(f"{sql_stats()}, r AS (SELECT doc_id, unnest({sql_reasons(DOCUMENTS)}) AS reason FROM s) SELECT reason, doc_id, rn FROM (SELECT reason, doc_id, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS rn FROM r) WHERE rn <= 5")
def reason_samples(t):
    """The first five documents of each reason."""
    x = reasoned(t("documents"), DOCUMENTS).select("doc_id", F.explode_outer("reasons").alias("reason")).where("reason is not null")
    return x.withColumn("rn", F.row_number().over(Window.partitionBy("reason").orderBy("doc_id"))).where("rn <= 5").select("reason", "doc_id", "rn")


@query(f"{sql_stats(False)} SELECT doc_id, doc_id || ',' || token_count || ',' || char_count || ',' || printf('%.4f', floor(alpha_ratio * 10000 + 0.5) / 10000) || ',' || printf('%.4f', floor(avg_token_length * 10000 + 0.5) / 10000) AS line FROM s")
def quality_csv_line(t):
    """K3: a line of the quality report, four decimals."""
    x = stats(t("documents"))
    return x.select("doc_id", F.format_string("%d,%d,%d,%.4f,%.4f", "doc_id", "token_count", "char_count", T.four(F.col("alpha_ratio")), T.four(F.col("avg_token_length"))).alias("line"))


@query(f"{DOC} SELECT len(tok) AS word_count, count(*) AS n FROM w GROUP BY 1")
def word_count_distribution(t):
    """A5"""
    return t("documents").select(F.size(T.tokens(english())).cast("long").alias("word_count")).groupBy("word_count").agg(F.count("*").alias("n"))


@query(f"SELECT language, count(*) AS n, round(avg(n_chars), 6) AS avg_chars FROM (SELECT l.language, n_chars FROM documents JOIN ({_sql_lang(T.SPANISH + T.INVERTED, 'unknown')}) l USING (doc_id)) GROUP BY language")
def language_distribution(t):
    """A5, A25"""
    return t("documents").select(T.detect_language(F.col("text"), True, "unknown").alias("language"), "n_chars").groupBy("language").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


@query(f"WITH l AS ({_sql_lang(T.SPANISH + T.INVERTED, 'unknown')}) SELECT lang, language, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents JOIN l USING (doc_id) GROUP BY lang, language")
def language_confusion(t):
    """The detector against the labels, by row share."""
    x = t("documents").select("lang", T.detect_language(F.col("text"), True, "unknown").alias("language")).groupBy("lang", "language").agg(F.count("*").alias("n"))
    return x.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 6))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\A[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+\z', '', 'g'), '[^a-zA-Z0-9'' -]+', '', 'g'), ' +', ' ', 'g') AS word FROM documents")
def clean_word(t):
    """Of the whole text."""
    return t("documents").select("doc_id", T.clean_word(F.col("text")).alias("word"))


@query(r"SELECT page_id, CASE WHEN s = '' THEN 'video' ELSE s END AS stem FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '(?s)^(.+)\.[^.]+$', '\1'), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM pages)")
def safe_stem(t):
    """X17"""
    return t("pages").select("page_id", T.safe_stem(F.col("url")).alias("stem"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\[[^\]]+\]', '', 'g'), '[ \t\n\v\f\r]+', ' ', 'g')) AS text FROM pages")
def strip_markup(t):
    """X18"""
    return t("pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query(f"{DOC} SELECT DISTINCT x AS word, CASE WHEN regexp_matches(x, '[^\\x00-\\x7F]') OR u = '' THEN '' ELSE substr(substr(u, 1, 1) || replace(" + "".join(["regexp_replace("] * 6) + "translate(substr(u, 2), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000')" + "".join(f", '{d}+', '{d}', 'g')" for d in range(1, 7)) + ", '0', '') || '000', 1, 4) END AS key FROM (SELECT x, upper(regexp_replace(x, '[^A-Za-z]', '', 'g')) AS u FROM (SELECT unnest(tok) AS x FROM w))")
def soundex_key(t):
    """X9, X13 over the vocabulary."""
    words = t("documents").select(F.explode(T.tokens(english())).alias("word")).distinct()
    return words.select("word", T.soundex(F.col("word")).alias("key"))


def sql_phonemes(c: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SOUNDS.items())
    return f"array_to_string(list_transform(list_filter(string_split(regexp_replace(lower({c}), '[^a-z]', '', 'g'), ''), lambda x: x <> ''), lambda x: CASE x {cases} END), ' ')"


@query(f"SELECT item_id, {sql_phonemes('text')} AS sounds FROM benchmark")
def text_to_phonemes(t):
    """X19, Z27"""
    return t("benchmark").select("item_id", F.array_join(T.phonemes(F.col("text")), " ").alias("sounds"))


@query(f"SELECT item_id, array_to_string(list_transform(string_split({sql_phonemes('text')}, ' '), lambda x: CASE x {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in T.SPELLINGS.items())} ELSE '' END), '') AS hint FROM benchmark")
def grapheme_hint(t):
    """X20, X21"""
    return t("benchmark").select("item_id", T.grapheme_hint(T.phonemes(F.col("text"))).alias("hint"))


@query("SELECT item_id, length(text) + (SELECT count(*) FROM unnest(range(1, length(text))) u(i) WHERE substr(text, i, 1) = substr(text, i + 1, 1)) AS frames FROM benchmark")
def ctc_required_frames(t):
    """W18"""
    return t("benchmark").select("item_id", T.ctc_frames(F.col("text")).cast("long").alias("frames"))


#: DuckDB's levenshtein counts bytes; Spark's, as the reference's, counts characters. So the SQL writes each accented
#: letter as one ASCII character that the benchmark does not hold.
LETTERS, ASCII = "éèêçüäößñóíáúàâÉÈÊÇÜÄÖÑÓÍÁÚÀÂ", "0123456789@#$%^&*_+=~<>{}[]|`"


def sql_lev(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, '{LETTERS}', '{ASCII}'), translate({b}, '{LETTERS}', '{ASCII}'))"


NEXT = "SELECT a.item_id, a.text AS target, b.text AS got FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"


def neighbours(t) -> DataFrame:
    b = t("benchmark")
    return b.select("item_id", F.col("text").alias("target")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("got")), "item_id")


@query(f"SELECT item_id, round({sql_lev("target", "got")} / greatest(1, length(target)), 6) AS cer FROM ({NEXT})")
def cer(t):
    """X24, A31"""
    return neighbours(t).select("item_id", F.round(T.error_rate(F.col("target"), F.col("got")), 6).alias("cer"))


@query(f"""WITH p AS (SELECT item_id, list_filter(string_split(target, ' '), lambda x: x <> '') AS a, list_filter(string_split(got, ' '), lambda x: x <> '') AS b FROM ({NEXT})),
v AS (SELECT *, list_distinct(list_concat(a, b)) AS v FROM p)
SELECT item_id, round(levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(list_position(v, x) AS INTEGER))), ''), array_to_string(list_transform(b, lambda x: chr(CAST(list_position(v, x) AS INTEGER))), '')) / greatest(1, len(a)), 6) AS wer FROM v""")
def wer(t):
    """X24"""
    words = lambda c: F.array_remove(F.split(c, " "), "")
    x = neighbours(t).select("item_id", words("target").alias("a"), words("got").alias("b"))
    return x.select("item_id", F.round(T.word_edit_distance(F.col("a"), F.col("b")) / F.greatest(F.lit(1), F.size("a")), 6).alias("wer"))


@query(f"SELECT item_id, round(CASE WHEN got = '' THEN 1.0 ELSE {sql_lev("target", "got")} / greatest(1, length(target), length(got)) END, 6) AS score FROM ({NEXT})")
def hint_score(t):
    """X25, X30"""
    x = neighbours(t)
    return x.select("item_id", F.round(F.when(F.col("got") == "", 1.0).otherwise(F.levenshtein("target", "got") / F.greatest(F.lit(1), F.length("target"), F.length("got"))), 6).alias("score"))


@query(f"SELECT count(*) AS n, round(avg({sql_lev("target", "got")} / greatest(1, length(target))), 6) AS mean_cer FROM ({NEXT})")
def mean_cer(t):
    """Macro average over samples."""
    return neighbours(t).agg(F.count("*").alias("n"), F.round(F.avg(T.error_rate(F.col("target"), F.col("got"))), 6).alias("mean_cer"))


VOCAB = r"(SELECT DISTINCT x FROM (SELECT unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9'' \x{00C0}-\x{024F}]+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS x FROM benchmark))"


@query(f"SELECT a.x AS word, b.x AS candidate, {sql_lev("a.x", "b.x")} AS distance FROM {VOCAB} a JOIN {VOCAB} b ON a.x < b.x AND abs(length(a.x) - length(b.x)) <= 2 AND {sql_lev("a.x", "b.x")} <= 2")
def edit_distance_pairs(t):
    """Distance at most 2; the equal length buckets make it a hash join."""
    v = t("benchmark").select(F.explode(T.tokens(english())).alias("w")).distinct()
    return ngrams.close_words(v.withColumnRenamed("w", "word"), v.withColumnRenamed("w", "candidate"), 2).where("word < candidate").select("word", "candidate", F.col("distance").cast("long").alias("distance"))


@query(f"SELECT word, candidate, distance FROM (SELECT a.x AS word, b.x AS candidate, {sql_lev("a.x", "b.x")} AS distance, row_number() OVER (PARTITION BY a.x ORDER BY {sql_lev("a.x", "b.x")}, b.x) AS rn FROM {VOCAB} a JOIN {VOCAB} b ON a.x <> b.x AND abs(length(a.x) - length(b.x)) <= 2 AND {sql_lev("a.x", "b.x")} <= 2) WHERE rn <= 25")
def correction_candidates(t):
    """The 25 nearest vocabulary words of each word."""
    v = t("benchmark").select(F.explode(T.tokens(english())).alias("w")).distinct()
    return ngrams.candidates(v.withColumnRenamed("w", "word"), v.withColumnRenamed("w", "candidate"), 2, 25).select("word", "candidate", F.col("distance").cast("long").alias("distance"))


STREAM = f"{DOC}, s AS (SELECT doc_id, i, tok[i] AS w1 FROM w, unnest(range(1, len(tok) + 1)) u(i)), g AS (SELECT w1, lead(w1) OVER (ORDER BY doc_id, i) AS w2, lead(w1, 2) OVER (ORDER BY doc_id, i) AS w3 FROM s)"


@query(f"{STREAM} SELECT w1, count(*) AS n FROM g GROUP BY w1")
def unigram_counts(t):
    """A26, S4"""
    return ngrams.counts(t("documents").select("doc_id", T.tokens(english()).alias("tok")), 1)


@query(f"{STREAM} SELECT w1, w2, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY w1, w2")
def bigram_counts(t):
    """Over the whole stream, across documents."""
    return ngrams.counts(t("documents").select("doc_id", T.tokens(english()).alias("tok")), 2)


@query(f"{STREAM} SELECT w1, w2, w3, count(*) AS n FROM g WHERE w3 IS NOT NULL GROUP BY w1, w2, w3")
def trigram_counts(t):
    """A26"""
    return ngrams.counts(t("documents").select("doc_id", T.tokens(english()).alias("tok")), 3)


@query(f"""{STREAM}, u AS (SELECT w1, count(*) AS n FROM g GROUP BY w1), b AS (SELECT w1, w2, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY ALL), c AS (SELECT w1, w2, w3, count(*) AS n FROM g WHERE w3 IS NOT NULL GROUP BY ALL),
q AS (SELECT item_id, i, tok[i] AS w, CASE WHEN i > 1 THEN tok[i - 1] END AS p1, CASE WHEN i > 2 THEN tok[i - 2] END AS p2 FROM (SELECT item_id, {TOKENS.format(NORM)} AS tok FROM benchmark), unnest(range(1, len(tok) + 1)) x(i)),
p AS (SELECT item_id, CASE WHEN p2 IS NOT NULL THEN (coalesce(c.n, 0) + 1) / (coalesce(bc.n, 0) + v) WHEN p1 IS NOT NULL THEN (coalesce(b.n, 0) + 1) / (coalesce(uc.n, 0) + v) ELSE (coalesce(u.n, 0) + 1) / (total + v) END AS p
 FROM q CROSS JOIN (SELECT count(*) AS v, sum(n) AS total FROM u) LEFT JOIN u ON u.w1 = w LEFT JOIN u uc ON uc.w1 = p1 LEFT JOIN b ON b.w1 = p1 AND b.w2 = w LEFT JOIN b bc ON bc.w1 = p2 AND bc.w2 = p1 LEFT JOIN c ON c.w1 = p2 AND c.w2 = p1 AND c.w3 = w)
SELECT item_id, round(avg(ln(p)), 6) AS avg_log_prob FROM p GROUP BY item_id""")
def ngram_log_prob(t):
    """Smoothed log-probabilities of the benchmark under the documents' counts."""
    docs = t("documents").select("doc_id", T.tokens(english()).alias("tok"))
    items = t("benchmark").select("item_id", T.tokens(english()).alias("tok"))
    return ngrams.average_log_prob(docs, items).select("item_id", F.round("avg_log_prob", 6).alias("avg_log_prob"))


@query("""WITH s AS (SELECT item_id, '^^' || lower(text) AS s FROM benchmark), p AS (SELECT s, i, k FROM s, unnest(range(3, length(s) + 1)) u(i), (VALUES (0), (1), (2)) v(k))
SELECT substr(s, i - k, k) AS context, substr(s, i, 1) AS ch, count(*) AS n FROM p GROUP BY 1, 2""")
def char_ngram_counts(t):
    """Contexts of every length up to order 3, padded with ^."""
    return ngrams.char_counts(t("benchmark").select(F.lower("text").alias("text")), 3)
