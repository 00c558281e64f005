"""Queries of the operators on training text, each beside its SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import chat, contamination, fingerprints, hard_negatives, jaccard_join, order_minhash, phrases, pieces, repeats, secrets, toxicity, urls
from tidepool.llm import words as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODEL = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@query("op6_sentencepiece")
def _(spark, d):
    path = model_path()

    def run(batches):
        # Both operators in one worker, so that ids and texts stay in Arrow.
        for batch in pieces.decode_batches(pieces.encode_batches(batches, path, "text", "ids"), path, "ids", "decoded"):
            ids, decoded = batch.column("ids"), batch.column("decoded")
            size = np.asarray(ids.value_lengths(), np.int64)
            raw, at = np.asarray(ids.flatten(), "<u4"), W.bounds(size)
            data, edge = W.flat(decoded)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(size),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string()),
                    pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(edge[:-1], edge[1:])], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return table(spark, d, "documents").select("doc_id", "text").mapInArrow(run, schema)


def sha_of(column) -> F.Column:
    """Lowercase hex digest of a text; NULL is the empty text."""
    return F.sha2(F.coalesce(column, F.lit("")), 256)


@query(
    "op9_decontamination",
    r"""with d as (select doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
               from documents),
         b as (select coalesce(cast(item_id as varchar), '') as item_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
         p as (select distinct item_id, least(len(w), 10) as m,
                 unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
                                       lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as pattern
               from b where len(w) > 0),
         g as (select row, m, unnest(range(1, len(w) - m + 2)) as i, w from d, (select distinct m from p) where len(w) >= m),
         o as (select row, m, i, item_id from (select row, m, i, array_to_string(w[i:i + m - 1], ' ') as pattern from g)
               join p using (m, pattern)),
         h as (select row, count(distinct k) as n from (select row, unnest(range(i, i + m)) as k from o) group by row),
         t as (select row, count(distinct item_id) as n, string_agg(distinct item_id, ',' order by item_id) as s
               from o group by row)
       select doc_id, cast(len(w) as bigint) as n_words, coalesce(h.n, 0) as n_hit, coalesce(t.n, 0) as n_items,
         sha256(coalesce(t.s, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
       from d left join h using (row) left join t using (row)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = contamination.mark(docs, table(spark, d, "benchmark")).drop("text")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha_of(F.array_join("items", ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op3_secret_scan")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = secrets.find(docs).drop("text")

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in secrets.KINDS],
        sha_of(joined(F.filter("spans", lambda s: s["kind"] != "random"))).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _windows_sql(length: int) -> str:
    """Common table expressions: words of each document, and its words in repeated windows."""
    return rf"""with d as (select doc_id, row_number() over () as row,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
         g as (select row, i, array_to_string(w[i:i + {length - 1}], ' ') as window_text
               from (select row, w, unnest(range(1, len(w) - {length - 2})) as i from d where len(w) >= {length})),
         r as (select window_text from g group by window_text having count(*) > 1),
         k as (select distinct row, unnest(range(i, i + {length})) as k from g join r using (window_text)),
         c as (select row, list(k order by k) as ks from k group by row)"""


@query(
    "op4_substring_dedup",
    _windows_sql(35)
    + """, n as (select row, string_agg(word, ' ' order by i) as kept
               from (select row, unnest(w) as word, generate_subscripts(w, 1) as i from d) x
               where not exists (select 1 from k where k.row = x.row and k.k = x.i) group by row)
       select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(ks), 0) as bigint) as n_removed,
         sha256(coalesce(kept, '')) as kept_sha256
       from d left join c using (row) left join n using (row)""",
)
def _(spark, d):
    kept = repeats.remove(table(spark, d, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_removed").cast("long").alias("n_removed"),
        sha_of(F.col("kept")).alias("kept_sha256"),
    )


@query(
    "op7_suffix_dedup",
    _windows_sql(50)
    + """, s as (select row, k, k - row_number() over (partition by row order by k) as run from k),
         p as (select row, string_agg(span, ',' order by lo) as passages
               from (select row, min(k) as lo, (min(k) - 1) || ':' || max(k) as span from s group by row, run) group by row)
       select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(ks), 0) as bigint) as n_repeated,
         coalesce(passages, '') as passages
       from d left join c using (row) left join p using (row)""",
)
def _(spark, d):
    found = repeats.passages(table(spark, d, "documents").select("doc_id", "text")).drop("text")
    size = F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"])
    spans = F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string")))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        size.alias("n_repeated"),
        F.array_join(spans, ",").alias("passages"),
    )


def held_out(key: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def toxicity_lexicon(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Lexicon:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.fit(docs.where(~held_out()), labels)


TOXIC = 0.7


@query("op5_toxicity")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_lexicon(spark, docs, d)).drop("text")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        "matches",
    )


@query("op1_url_filter")
def _(spark, d):
    model = urls.fit(urls.labelled(spark))
    judged = urls.judge(table(spark, d, "pages").select("page_id", "url"), model)
    return judged.select("page_id", "host", "path", "rule", "verdict", "probability")


_ESCAPED = r"""regexp_replace(regexp_replace({}, '(<)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)', '\1\\\2\3', 'g'),
                 '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g')"""


@query(
    "op10_chat_format",
    rf"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                    union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
                    union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
         e as (select *, {_ESCAPED.format("role")} as r, {_ESCAPED.format("text")} as x from c)
       select conv_id, count(*) as n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
         cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
         sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
         cast(sum(length('<|im_start|>') + length(replace(replace(r, '\', '\\'), chr(10), '\n')) + 1 + length(x)
             + length('<|im_end|>') + 1) as bigint) as formatted_chars
       from e group by conv_id""",
)
def _(spark, d):
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat.render(chat.canonical(rows)).select("conv_id", "formatted", "loss_mask")
    back = chat.read_back(F.col("formatted"))
    text = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.learned(F.col("formatted"), F.col("loss_mask"))
    return done.select(
        "conv_id",
        F.size(back).cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op2_fingerprint")
def _(spark, d):
    def run(batches):
        for keys, texts, samples, following, next_samples in fingerprints.in_order(batches):
            changed = [fingerprints.edited(t, f) for t, f in zip(texts, following)]
            other = fingerprints.signatures(pa.array(changed, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    fingerprints.written(samples),
                    fingerprints.written(other),
                    pa.array((samples == other).mean(axis=1)),
                    pa.array((samples == next_samples).mean(axis=1)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = """doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,
                near_edited double, near_next double"""
    return fingerprints.with_successors(table(spark, d, "documents")).mapInArrow(run, schema)


@query("op8_near_duplicates")
def _(spark, d):
    found = order_minhash.classes(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "n_links")


@query(
    "op11_hard_negatives",
    """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                 list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
               where label is not null and embedding is not null
                 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
         s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
                 cast(list_dot_product(a.e, b.e) as bigint) as score
               from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
         p as (select anchor_id, other as positive_id, score as positive_score from s where same
               qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
       select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id
                order by score desc, other) as integer) as rank, other as negative_id, positive_score, score as negative_score
       from p join s using (anchor_id)
       where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
       qualify rank <= 3""",
)
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


@query(
    "op12_collocations",
    r"""with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz') as t from documents),
         p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
               from (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
         n as (select lang, cast(sum(len(w)) as bigint) as n from p group by lang),
         g as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase
               from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i
                     from p, (values (1), (2), (3), (4)) s(m) where len(w) >= m)),
         c as (select lang, m, phrase, count(*) as f from g group by all having count(*) >= 30),
         k as (select lang, phrase, m, f as a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from c where m > 1),
         x as (select k.lang, k.phrase, k.a, k.k, l.f as l, r.f as r,
                 (2000000 * cast(k.a as hugeint)) // (cast(l.f as hugeint) + r.f) as score
               from k join c l on l.lang = k.lang and l.phrase = array_to_string(k.w[1:k.k], ' ')
                      join c r on r.lang = k.lang and r.phrase = array_to_string(k.w[k.k + 1:], ' ')
               qualify row_number() over (partition by k.lang, k.phrase order by score, k.k) = 1),
         i as (select lang, array_to_string(w[j:j + z - 1], ' ') as phrase, f
               from (select lang, w, f, z, unnest(range(1, m - z + 2)) as j
                     from (select lang, m, f, string_split(phrase, ' ') as w, unnest(range(2, m)) as z from c where m > 2))),
         o as (select lang, phrase, max(f) as longer from i group by all)
       select x.lang, row_number() over (partition by x.lang order by score desc, a desc, x.phrase) as rank, x.phrase,
         a, l, r, n, cast(score as bigint) as score
       from x left join o using (lang, phrase) join n using (lang)
       where coalesce(100 * cast(longer as hugeint) < 80 * cast(a as hugeint), true)
       qualify rank <= 2000""",
)
def _(spark, d):
    return phrases.collocations(table(spark, d, "documents").select("lang", "text"))


@query(
    "op13_jaccard_join",
    r"""with recursive d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
         s as (select distinct row, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') as g
               from (select row, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) as i from d where len(w) > 0)),
         n as (select row, count(*) as n from s group by row),
         x as (select a.row as a, b.row as b, count(*) as shared from s a join s b on a.g = b.g and a.row <> b.row group by all),
         e as (select a, b from x join n na on na.row = a join n nb on nb.row = b
               where 100 * shared >= 85 * (na.n + nb.n - shared)),
         r(row, other) as (select row, row from d union select r.row, e.b from r join e on r.other = e.a),
         c as (select r.row, min(o.doc_id) as component_id from r join d o on o.row = r.other group by r.row)
       select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id
       from d join c using (row) left join n using (row)""",
)
def _(spark, d):
    return jaccard_join.join(table(spark, d, "documents").select("doc_id", "text"))
