"""The registered queries ``opN_<name>``: thin digests of the operators over the given tables, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roleweave.llm import align, bpe, chat, html, language, merkle, mixing, quality, secrets, simhash, topk, toxicity, urlfilter
from roleweave.llm.common import id_hash, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A production tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the host rules and globs."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id hash mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_hash("doc_id") % 4 == 2, F.lit(False))
    model = language.train(docs.where(~held_out))
    out = language.identify(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled ones whose id hash mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_hash("doc_id") % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    out = toxicity.score(docs, toxicity.train(docs, labels))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows by inner product for each twentieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select("vec_id", topk.quantized(rows["embedding"]).alias("v"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) q from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (select a.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint score
      from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[number(k) for k in secrets.KINDS], F.sha2(secrets.written("base"), 256).alias("base_sha256"), secrets.written("spans").alias("spans"),
        F.size("live").cast("long").alias("n_live"),
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, rate and copies of every document for the production mixture."""
    docs = table(spark, sf_dir, "documents")
    model = mixing.train(docs, mixing.domains(table(spark, sf_dir, "labels")))
    return mixing.mix(docs, model, mixing.TARGETS, mixing.ANCHOR).select("doc_id", "n_words", "domain", "rate", "copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and adaptive verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of every document's ids and decoded text."""
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


#: The conversation whose texts hold every control string and the escape character.
PROBE = r"\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and digests read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return chat.digests(chat.format_turns(rows.select("conv_id", "turn", "role", "text").unionByName(probe)))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, checked against a copy with altered rows."""
    docs = table(spark, sf_dir, "documents")
    made = merkle.manifest(docs, merkle.one_more_character(docs))
    return made.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("steps"))).alias("proof_sha256"),
        merkle.fold(F.coalesce("altered_leaf", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document aligned between two tokenizers, with corpus-wide counts of its links."""
    found = align.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus_pipeline.run``: the five stages over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_language_id, op3_simhash, op4_toxicity, op5_top_k, op6_secrets, op7_html_text, op8_mixing, op9_quality, op10_bpe, op11_chat_format, op12_merkle, op13_align, pipeline)
}


def _glob_regex(glob: str) -> str:
    parts = re.findall(r"\*+|[^*]+", glob)
    return "".join("(?s:.*)" if p[:2] == "**" else "[^/]*" if p == "*" else re.escape(p) for p in parts).replace("'", "''")


def _op1_sql() -> str:
    """The rules by suffix and prefix tests, the globs as anchored regular expressions."""
    rules = [(v, h, p, f"{h}{p}") for v, h, p in urlfilter.RULES]
    rules.sort(key=lambda r: -len(r[3]))
    globs = sorted(urlfilter.GLOBS, key=lambda g: -len(g[1]))
    fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then" for _, h, p, _ in rules]
    matched = [f"when regexp_full_match(concat(host, path), '{_glob_regex(g)}') then" for _, g in globs]
    rule = "case " + " ".join(f"{f} '{r[3]}'" for f, r in zip(fits, rules)) + " end"
    verdict = "case " + " ".join(f"{f} '{r[0]}'" for f, r in zip(fits, rules))
    verdict += " " + " ".join(f"{m} '{v}'" for m, (v, _) in zip(matched, globs)) + f" else '{urlfilter.ALLOW}' end"
    glob = "case " + " ".join(f"{f} null" for f in fits) + " " + " ".join(f"{m} '{g}'" for m, (_, g) in zip(matched, globs)) + " end"
    return f"""
with u as (select page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages)
select page_id, host, path, {rule} as rule, {verdict} as verdict, {glob} as glob from u
"""


def _op9_sql() -> str:
    """Features by unnested windows; quartiles are exact, as the sketches are for groups of this size."""
    word = r"[^\x20\x09-\x0D]"
    fails = []
    quartiles = []
    for name, low, present, times, least in quality.RULES:
        reach = f"{times} * greatest(q_{name}[2] - q_{name}[1], {least})"
        fails.append(f"({name} > q_{name}[2] + {reach}" + (f" or {name} < q_{name}[1] - {reach})" if low else ")"))
        value = f"nullif({name}, 0)" if present else name
        quartiles.append(f"[quantile_disc({value}, 0.25), quantile_disc({value}, 0.75)] as q_{name}")
    return f"""
with d as (select doc_id, lang, source, coalesce(text, '') as text from documents),
t as (select *, regexp_extract_all(text, '{word}+') as w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) as l from d),
win as (select doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') as s
        from (select doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) as i from t where len(w) >= {quality.WINDOW})),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from win) where n > 1),
covered as (select doc_id, sum(least({quality.WINDOW}, coalesce(nxt - i, {quality.WINDOW}))) as n
            from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from twice) group by doc_id),
f as (select t.doc_id, lang, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines,
             len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
      from t left join covered c on c.doc_id = t.doc_id),
r as (select *, case when n_words > 0 then word_chars / n_words else 0.0 end as mean_word,
             case when word_chars > 0 then n_symbols / word_chars else 0.0 end as symbol_ratio,
             case when n_lines > 0 then n_dup_lines / n_lines else 0.0 end as dup_line_ratio,
             case when n_words > 0 then n_repeat_words / n_words else 0.0 end as repeat_ratio,
             n_words < {quality.FEWEST_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words as base_failed from f),
q as (select lang, source, {', '.join(quartiles)} from r where not base_failed group by lang, source)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words,
       base_failed, not base_failed and not ({" or ".join(f"coalesce({x}, false)" for x in fails)}) as kept
from r left join q on r.lang is not distinct from q.lang and r.source is not distinct from q.source
"""


OP11_SQL = r"""
with c as (select conv_id, turn, role, text from conversations
           union all select -7, n, ['user', 'assistant'][n + 1], '\### Assistant: </turn> ok' from range(2) t(n)),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c),
s as (select *, lag(role) over w as before, lead(role) over w is null as last from t
      window w as (partition by conv_id order by turn nulls first, role, text)),
m as (select *, coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
             + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 as escapes,
             case before when 'system' then role = 'user' when 'user' then role = 'assistant' when 'assistant' then role in ('user', 'tool')
                         when 'tool' then role in ('tool', 'assistant') else before is null and role in ('system', 'user') end as fits from s)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('### ') + case when role in ('system', 'user', 'assistant', 'tool') then length(role) else
             1 + length(role) + (length(role) - length(replace(role, ':', ''))) end + length(': ') + length(text) + escapes + length('</turn>') + 1)::bigint as formatted_chars,
       bool_and(fits) and bool_or(last and role = 'assistant') as valid
from m group by conv_id
"""

#: Leaves, levels and siblings by recursion over the whole tables; crc32 bit by bit.
OP12_SQL = """
with recursive d as (select doc_id, lang, row_number() over () as r,
    list_transform([doc_id::varchar, source, lang, text], lambda x: coalesce(strlen(x) || ':' || x, '-')) as f, n_chars,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(doc_id::varchar)), lambda i: ascii(substring(doc_id::varchar, (i + 1)::int, 1))::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) as crc from documents),
e as (select *, sha256(f[1] || f[2] || f[3] || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || f[4]) as leaf,
             sha256(f[1] || f[2] || f[3] || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || f[4]) as altered from d),
leaves as materialized (select r, doc_id, lang, leaf, case when crc % 7 = 0 then altered else leaf end as given,
                  row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as i, count(*) over (partition by lang) as n from e),
lv as (select 0 as lvl, lang, i, leaf as h, n from leaves
       union all select lvl + 1, lang, i // 2, sha256(string_agg(h, '' order by i)), max((n + 1) // 2) from lv where n > 1 group by lvl, lang, i // 2),
sub as materialized (select lang, h, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from lv where n = 1),
tv as (select 0 as lvl, i, h, n from sub
       union all select lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), max((n + 1) // 2) from tv where n > 1 group by lvl, i // 2),
up as (select distinct lang, lvl from lv where n > 1), tup as (select distinct lvl from tv where n > 1),
flank as (select l.r, 0 as part, up.lvl, s.i < (l.i >> up.lvl) as before, s.h from leaves l join up on l.lang is not distinct from up.lang
            left join lv s on s.lang is not distinct from l.lang and s.lvl = up.lvl and s.i = xor(l.i >> up.lvl, 1)
          union all select l.r, 1, tup.lvl, s.i < (b.i >> tup.lvl), s.h from leaves l join sub b on l.lang is not distinct from b.lang cross join tup
            left join tv s on s.lvl = tup.lvl and s.i = xor(b.i >> tup.lvl, 1)),
proof as (select r, list(case when before then 'l' else 'r' end || coalesce(h, '') order by part, lvl) as steps, string_agg(h, '' order by part, lvl) as p from flank group by r),
x as (select doc_id, leaf, b.h as subroot, (select h from tv where n = 1) as root, sha256(coalesce(p, '')) as proof_sha256,
             list_reduce(list_prepend(given, coalesce(steps, []::varchar[])), lambda a, s: sha256(case when s[1] = 'l' then s[2:] || a else a || s[2:] end)) as folded_root
      from leaves l join sub b on l.lang is not distinct from b.lang left join proof on proof.r = l.r)
select *, folded_root = root as verified from x
"""

ORACLE = {"op1_url_filter": _op1_sql(), "op5_top_k": OP5_SQL, "op9_quality": _op9_sql(), "op11_chat_format": OP11_SQL, "op12_merkle": OP12_SQL}
