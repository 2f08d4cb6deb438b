"""The engine's own queries by name, and the SQL each is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bpe, scalars
from ..operators import blocks, positions, runs, scoring, splits, vocab
from ..session import on_disk_bytes, read_table, scratch_root, spread, stage_table
from ..sources import corpus, tokenbin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


VAL = 0.05
_SPLIT = f"""k AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':2357'), doc_id) AS r, count(*) OVER () AS n
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
s AS (SELECT doc_id, CASE WHEN r <= ceil(n * {VAL}e0) THEN 'val' ELSE 'train' END AS split FROM k)"""
_CHARS = "c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents"))


def _split_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return docs.drop("split").join(splits.fraction_split(docs, "doc_id", VAL), "doc_id")


@query(f"""WITH {_SPLIT}, {_CHARS},
m AS (SELECT split, ch, count(*) AS m FROM c JOIN s USING (doc_id) GROUP BY split, ch),
t AS (SELECT ch, m AS n FROM m WHERE split = 'train'),
z AS (SELECT coalesce(sum(n), 0) AS tot, count(*) AS v FROM t)
SELECT CAST(sum(m.m) AS BIGINT) AS total_chars, round(sum(m.m * -ln((coalesce(t.n, 0) + 1) / (z.tot + z.v + 1))) / sum(m.m), 6) AS avg_loss_nats,
    round(exp(sum(m.m * -ln((coalesce(t.n, 0) + 1) / (z.tot + z.v + 1))) / sum(m.m)), 6) AS perplexity
FROM m LEFT JOIN t USING (ch) CROSS JOIN z WHERE m.split = 'val'""")
def char_ppl_unigram(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity of the val split under an add-one character model of the train split."""
    counts = stage_table(vocab.char_counts(_split_documents(spark, d), "text", "split"), "chars")
    train = counts.where("split = 'train'").select("ch", F.col("n").alias("t"))
    total = F.broadcast(train.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("tot"), F.count("*").alias("v")))  # one row
    rows = counts.where("split = 'val'").join(train, "ch", "left").join(total)
    nll = F.col("n") * -F.ln((F.coalesce("t", F.lit(0)) + 1) / (F.col("tot") + F.col("v") + 1))
    out = scoring.perplexity(rows.select(nll.alias("nll"), F.col("n").alias("n_targets")))
    return out.select(F.col("total_tokens").alias("total_chars"), F.round("avg_loss_nats", 6).alias("avg_loss_nats"), F.round("perplexity", 6).alias("perplexity"))


@query(f"WITH {_SPLIT} SELECT doc_id, split FROM s")
def split_fraction(spark: SparkSession, d: str) -> DataFrame:
    return splits.fraction_split(_documents(spark, d), "doc_id", VAL)


@query(f"""WITH {_SPLIT}, j AS (SELECT * FROM s)
SELECT count(*) AS n_all, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'train') AS n_train, CAST(0 AS BIGINT) AS n_both FROM j""")
def split_complement(spark: SparkSession, d: str) -> DataFrame:
    """Train is everything but val: sizes, and how many keys are in both."""
    s = splits.fraction_split(_documents(spark, d), "doc_id", VAL)
    sides = s.groupBy("doc_id").agg(F.count_distinct("split").alias("k"), F.first("split").alias("split"))
    return sides.agg(F.count("*").alias("n_all"), F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("k") > 1).alias("n_both"))


@query(f"""WITH {_SPLIT} SELECT s.split, count(*) AS n_docs, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM documents JOIN s USING (doc_id) GROUP BY s.split""")
def split_char_counts(spark: SparkSession, d: str) -> DataFrame:
    return _split_documents(spark, d).groupBy("split").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


@query("""SELECT CASE split WHEN 'validation' THEN 'val' ELSE split END AS split, count(*) AS n_records, CAST(sum(len(ids)) AS BIGINT) AS n_tokens
FROM (SELECT rec_id, any_value(split) AS split, any_value(ids) AS ids FROM general_purpose_prepare WHERE rec_id IS NOT NULL GROUP BY rec_id)
WHERE split IN ('train', 'validation', 'test') GROUP BY 1""")
def split_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per resolved split; lengths come from the arrays, as the delivered ones may be off."""
    rows = read_table(spark, d, "general_purpose_prepare").where("rec_id is not null").select("rec_id", "split", F.size("ids").alias("n")).dropDuplicates(["rec_id"])
    names = [r[0] for r in rows.select("split").where("split is not null").distinct().collect()]  # split names
    kept = splits.apply_plan(rows, corpus.resolve_splits(names), "rec_id")
    return kept.groupBy("split").agg(F.count("*").alias("n_records"), F.sum(F.when(F.col("n") >= 0, F.col("n")).cast("long")).alias("n_tokens"))


_NAMES = ("train|val", "train|validation|test", "train|val|validation", "train|test", "train", "data", "a|b", "train|val|dev", "train|holdout|test")


@query("""WITH n(names, val, test) AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', {v}, {t})" for n in _NAMES for v in ("NULL", "'dev'") for t in ("NULL", "'holdout'")) + """) v(names, val, test)),
h AS (SELECT *, string_split(names, '|') AS l FROM n),
p AS (SELECT *, list_contains(l, 'train') AS tr, coalesce(list_contains(l, val), false) AS nv, CASE WHEN list_contains(l, test) THEN test END AS nt,
    CASE WHEN list_contains(l, 'validation') THEN 'validation' WHEN list_contains(l, 'val') THEN 'val' END AS iv FROM h)
SELECT names, val AS named_val, test AS named_test,
    CASE WHEN tr THEN 'train' WHEN len(l) = 1 THEN l[1] END AS train_from,
    CASE WHEN tr AND nv THEN val WHEN tr THEN coalesce(iv, 'train') WHEN len(l) = 1 THEN l[1] END AS val_from,
    CASE WHEN tr AND nv THEN nt WHEN tr THEN coalesce(nt, CASE WHEN list_contains(l, 'test') THEN 'test' END) END AS test_from,
    coalesce(CASE WHEN tr AND nv THEN false WHEN tr THEN iv IS NULL ELSE len(l) = 1 END, false) AS cut, NOT tr AND len(l) > 1 AS fails FROM p""")
def split_resolution(spark: SparkSession, d: str) -> DataFrame:
    """What `resolve_splits` decides for sets of split names; nulls where it raises."""
    rows = []
    for names in _NAMES:
        for val in (None, "dev"):
            for test in (None, "holdout"):
                try:
                    p = corpus.resolve_splits(names.split("|"), "train", val, test)
                    rows.append((names, val, test, p.train, p.val, p.test, p.cut, False))
                except ValueError:
                    rows.append((names, val, test, None, None, None, False, True))
    return spark.createDataFrame(rows, "names string, named_val string, named_test string, train_from string, val_from string, test_from string, cut boolean, fails boolean")


@query("""SELECT doc_id, substr(text, 1, CAST(floor(length(text) * 0.9e0) AS BIGINT)) AS head, substr(text, CAST(floor(length(text) * 0.9e0) AS BIGINT) + 1) AS tail FROM documents""")
def head_tail_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.head_tail(read_table(spark, d, "documents")).select("doc_id", "head", "tail")


@query(r"""SELECT doc_id, length(regexp_replace(text, '\r\n?', chr(10), 'g')) AS n_chars, md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS text_md5 FROM documents""")
def newline_translation(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select("doc_id", corpus.newlines(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(f"WITH {_CHARS} SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS id FROM (SELECT DISTINCT ch FROM c)")
def char_vocab(spark: SparkSession, d: str) -> DataFrame:
    return vocab.char_vocabulary(_documents(spark, d)).select("ch", F.col("id").cast("long").alias("id"))


@query(f"""WITH {_CHARS} SELECT count(DISTINCT ch) AS vocab_size, count(*) AS n_chars FROM c""")
def char_vocab_size(spark: SparkSession, d: str) -> DataFrame:
    return vocab.char_counts(_documents(spark, d)).agg(F.count("*").alias("vocab_size"), F.sum("n").alias("n_chars"))


@query("""WITH t AS (SELECT doc_id, string_split(text, '') AS l FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, unnest(l) AS ch, generate_subscripts(l, 1) AS i FROM t),
v AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS id FROM (SELECT DISTINCT ch FROM c))
SELECT doc_id, count(*) AS n_ids, CAST(sum(id * i) AS BIGINT) AS checksum FROM c JOIN v USING (ch) GROUP BY doc_id""")
def char_encode(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).where(F.length("text") > 0).select("doc_id", "text")
    ids = vocab.char_encode(docs, stage_table(vocab.char_vocabulary(docs), "vocab"))
    total = F.aggregate(F.transform("ids", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), total.alias("checksum"))


@query("SELECT count(*) AS n_docs, count(text) AS n_texts, count(text) AS n_equal FROM documents")
def char_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select("doc_id", "text")
    v = stage_table(vocab.char_vocabulary(docs), "vocab")
    back = vocab.char_decode(vocab.char_encode(docs, v), v)
    return back.agg(F.count("*").alias("n_docs"), F.count("text").alias("n_texts"), F.count_if(F.col("text") == F.col("decoded")).alias("n_equal"))


# ------------------------------------------------------------ token streams

_STREAM = """r AS (SELECT rec_id, any_value(ids) AS ids FROM general_purpose_prepare WHERE split = 'train' AND rec_id IS NOT NULL AND len(ids) > 0 GROUP BY rec_id)"""
_TOKENS = _STREAM + """, u AS (SELECT rec_id, unnest(ids) AS tok, generate_subscripts(ids, 1) AS i FROM r),
p AS (SELECT tok, row_number() OVER (ORDER BY rec_id, i) - 1 AS pos FROM u)"""
_BLOCKS = _TOKENS + """, z AS (SELECT count(*) AS n FROM p),
x AS (SELECT pos // 1024 AS block_id, CAST(sum(tok) AS BIGINT) AS sum_x, min_by(tok, pos) AS first_x FROM p GROUP BY 1),
y AS (SELECT (pos - 1) // 1024 AS block_id, CAST(sum(tok) AS BIGINT) AS sum_y, max_by(tok, pos) AS last_y, count(*) AS n_y FROM p WHERE pos > 0 GROUP BY 1),
b AS (SELECT block_id, n_y, sum_x, sum_y, first_x, last_y FROM x JOIN y USING (block_id), z WHERE block_id < (n - 1) // 1024)"""


def _stream_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the stream, those delivered twice still twice."""
    return spread(read_table(spark, d, "general_purpose_prepare").where("split = 'train' and rec_id is not null and size(ids) > 0").select("rec_id", "ids"))


def _stream_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _stream_rows(spark, d).select("rec_id", F.size("ids").alias("n")).dropDuplicates(["rec_id"])


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return blocks.placed_stream(_stream_rows(spark, d), "rec_id", distinct=True)


@query(f"WITH {_STREAM} SELECT rec_id, CAST(coalesce(sum(len(ids)) OVER (ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, len(ids) AS size FROM r")
def doc_offsets(spark: SparkSession, d: str) -> DataFrame:
    return positions.running_offsets(_stream_rows(spark, d), "rec_id", F.size("ids"), distinct=True).select("rec_id", "start", "size")


def _block_sums(b: DataFrame, *more: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return b.select("block_id", *more, F.size("y").cast("long").alias("n_y"), total("x").alias("sum_x"), total("y").alias("sum_y"), F.element_at("x", 1).alias("first_x"), F.element_at("y", -1).alias("last_y"))


@query(f"WITH {_BLOCKS} SELECT * FROM b")
def pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _block_sums(blocks.pack_blocks(_stream(spark, d)))


@query(f"WITH {_BLOCKS}, c AS (SELECT count(*) AS k FROM b) SELECT b.*, block_id // 8 AS batch_id FROM b, c WHERE block_id < k // 8 * 8")
def eval_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _block_sums(blocks.full_batches(stage_table(blocks.pack_blocks(_stream(spark, d)), "blocks")), "batch_id")


@query(f"""WITH {_TOKENS}, n AS (SELECT count(*) AS n FROM p), c AS (SELECT (n - 1) // 1024 // 8 AS k FROM n),
e AS (SELECT pos, pos // 8192 AS batch_id, tok, pos % 8192 AS place FROM p, c WHERE pos < k * 8192)
SELECT batch_id, CAST(count(*) // 1024 AS BIGINT) AS n_rows, 1024::BIGINT AS width, CAST(sum(tok * (place + 1)) AS BIGINT) AS checksum FROM e GROUP BY batch_id""")
def stacked_batches(spark: SparkSession, d: str) -> DataFrame:
    """The full batches as matrices: rows, width, and a sum of all inputs weighted by their place."""
    stacked = blocks.stack_batches(blocks.full_batches(stage_table(blocks.pack_blocks(_stream(spark, d)), "blocks")))
    weighted = F.aggregate(F.transform(F.flatten("xs"), lambda t, i: t.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return stacked.select("batch_id", F.size("xs").cast("long").alias("n_rows"), F.array_max(F.transform("xs", lambda r: F.size(r))).cast("long").alias("width"), weighted.alias("checksum"))


@query(f"""WITH {_BLOCKS}, c AS (SELECT count(*) AS k FROM b),
t AS (SELECT tok, count(*) AS n FROM p GROUP BY tok), s AS (SELECT sum(n) + count(*) + 1 AS tot FROM t),
e AS (SELECT tok FROM p, c WHERE pos > 0 AND pos <= k // 8 * 8 * 1024)
SELECT count(*) AS total_tokens, round(avg(ln(tot) - ln(n + 1)), 6) AS avg_loss_nats, round(exp(avg(ln(tot) - ln(n + 1))), 5) AS perplexity FROM e JOIN t USING (tok), s""")
def token_ppl_unigram(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity of the stream's full batches under its own add-one token counts, by the scorer interface."""
    placed = _stream(spark, d)
    counts = placed.select(F.explode("ids").alias("tok")).groupBy("tok").count()
    scorer = scoring.create_scorer("unigram", dict(map(tuple, counts.collect())))  # one entry per token of the vocabulary
    kept = blocks.full_batches(stage_table(blocks.pack_blocks(placed), "blocks"))
    out = scoring.perplexity(scoring.score_blocks(kept, scorer))
    return out.select("total_tokens", F.round("avg_loss_nats", 6).alias("avg_loss_nats"), F.round("perplexity", 5).alias("perplexity"))


@query(f"WITH {_STREAM} SELECT rec_id, ntile(7) OVER (ORDER BY rec_id) - 1 AS shard FROM r")
def contiguous_shards(spark: SparkSession, d: str) -> DataFrame:
    return positions.contiguous_shards(stage_table(_stream_lengths(spark, d).select("rec_id"), "keys"), "rec_id", 7)


@query(f"""WITH {_STREAM}, n AS (SELECT sum(len(ids)) AS n FROM r), g AS (SELECT unnest(range(480)) AS id)
SELECT id // 12 AS step, id % 12 AS slot, CAST(CAST(('0x' || substr(md5('1337:' || (id // 12) || ':' || (id % 12)), 1, 12)) AS BIGINT) % (n - 1024) AS BIGINT) AS start FROM g, n""")
def sample_starts(spark: SparkSession, d: str) -> DataFrame:
    n = _stream_lengths(spark, d).agg(F.sum("n")).first()[0]
    return blocks.sample_starts(spark, 40, 12, n)


@query(f"""WITH {_TOKENS}, n AS (SELECT count(*) AS n FROM p), g AS (SELECT unnest(range(480)) AS id),
w AS (SELECT id // 12 AS step, id % 12 AS slot, CAST(CAST(('0x' || substr(md5('1337:' || (id // 12) || ':' || (id % 12)), 1, 12)) AS BIGINT) % (n - 1024) AS BIGINT) AS start FROM g, n)
SELECT step, slot, start, CAST(sum(tok) FILTER (pos < start + 1024) AS BIGINT) AS sum_x, CAST(sum(tok) FILTER (pos > start) AS BIGINT) AS sum_y
FROM w JOIN p ON pos >= start AND pos <= start + 1024 GROUP BY ALL""")
def sample_windows(spark: SparkSession, d: str) -> DataFrame:
    placed = _stream(spark, d)
    n = placed.agg(F.max(F.col("start") + F.size("ids"))).first()[0]
    got = blocks.windows_at(placed, blocks.sample_starts(spark, 40, 12, n))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return got.select("step", "slot", "start", total("x").alias("sum_x"), total("y").alias("sum_y"))


@query(f"WITH {_TOKENS}, l AS (SELECT tok AS x, lead(tok) OVER (ORDER BY pos) AS y FROM p) SELECT x, y, count(*) AS n FROM l WHERE y IS NOT NULL GROUP BY x, y")
def next_token_pairs(spark: SparkSession, d: str) -> DataFrame:
    return blocks.next_token_counts(_stream(spark, d))


@query(f"WITH {_STREAM} SELECT count(*) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS n_tokens, CAST(sum(list_sum(ids)) AS BIGINT) AS sum_ids FROM r")
def token_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The stream written to a binary token file and read back by byte ranges."""
    tokenbin.register(spark)
    placed = _stream(spark, d)
    path = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex[:8]}.bin"
    placed.select("start", "ids").write.format("tokenbin").option("dtype", tokenbin.dtype_for(bpe.END_OF_TEXT)).mode("overwrite").save(path)
    back = spark.read.format("tokenbin").load(path).agg(F.count("*").alias("n_tokens"), F.sum("token_id").alias("sum_ids"))
    return placed.agg(F.count("*").alias("n_docs")).join(back)


@query("""WITH r AS (SELECT web_id, any_value(ids) AS ids FROM owt_prepare WHERE web_id IS NOT NULL AND ids IS NOT NULL GROUP BY web_id),
u AS (SELECT web_id, unnest(ids) AS token_id, generate_subscripts(ids, 1) AS i FROM r)
SELECT web_id, md5(string_agg(piece, '' ORDER BY i)) AS text_md5 FROM u JOIN token_vocab USING (token_id) WHERE token_id <> 50256 GROUP BY web_id""")
def token_decode(spark: SparkSession, d: str) -> DataFrame:
    """Texts from ids by the vocabulary of pieces, the end mark left out."""
    rows = spread(read_table(spark, d, "owt_prepare").where("web_id is not null and ids is not null").select("web_id", "ids")).dropDuplicates(["web_id"])
    pieces = read_table(spark, d, "token_vocab").where(F.col("token_id") != bpe.END_OF_TEXT)
    if on_disk_bytes(pieces) > 64 << 20:
        t = rows.select("web_id", F.posexplode("ids").alias("i", "token_id")).join(pieces, "token_id")
        text = t.groupBy("web_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "").alias("t"))
    else:
        table = vocab.dense_array(pieces.withColumn("piece", F.coalesce("piece", F.lit(""))), "token_id", "piece", "pieces")
        text = rows.join(F.broadcast(table)).select("web_id", F.array_join(F.transform("ids", lambda i: F.coalesce(F.get("pieces", i), F.lit(""))), "").alias("t")).where("t != ''")
    return text.select("web_id", F.md5("t").alias("text_md5"))


@query("""SELECT source, max(m) AS max_token, CASE WHEN max(m) IS NULL THEN 'uint32' WHEN max(m) < 65536 THEN 'uint16' WHEN max(m) < 4294967296 THEN 'uint32' ELSE 'uint64' END AS dtype
FROM (SELECT source, list_max(ids) AS m FROM general_purpose_prepare) GROUP BY source""")
def dtype_choice(spark: SparkSession, d: str) -> DataFrame:
    top = read_table(spark, d, "general_purpose_prepare").groupBy("source").agg(F.max(F.array_max("ids")).alias("max_token"))
    return top.withColumn("dtype", scalars.dtype_choice(F.col("max_token").cast("long")))


@query()
def bpe_lengths(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_text(read_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "len")


@query()
def bpe_eot_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the documents encoded with an end mark each."""
    ids = stage_table(bpe.encode_text(read_table(spark, d, "documents").select("doc_id", "text"), append_eot=True).select("doc_id", "ids"), "ids")
    return _block_sums(blocks.pack_blocks(blocks.placed_stream(ids)))


@query("SELECT rec_id, len(ids) + 1 AS len, 50256 AS last_id, ids[-1] AS before_last FROM (SELECT rec_id, any_value(ids) AS ids FROM general_purpose_prepare WHERE ids IS NOT NULL AND rec_id IS NOT NULL GROUP BY rec_id)")
def append_end(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "general_purpose_prepare").where("ids is not null and rec_id is not null").select("rec_id", bpe.append_end("ids").alias("ended"))
    rows = rows.select("rec_id", F.size("ended").cast("long").alias("len"), F.element_at("ended", -1).alias("last_id"), F.get("ended", F.size("ended") - 2).alias("before_last"))
    return rows.dropDuplicates(["rec_id"])


# ------------------------------------------------------------ models and runs


@query("""SELECT vec_id, round(ln(list_sum(list_transform(e, lambda z: exp(z - list_max(e))))) + list_max(e) - e[label + 1], 5) AS nll
FROM (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)""")
def softmax_nll(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", F.round(scoring.softmax_nll(F.col("embedding"), F.col("label")), 5).alias("nll"))


@query("""SELECT token_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 5) AS total FROM token_vocab JOIN embeddings ON vec_id = token_id""")
def embedding_gather(spark: SparkSession, d: str) -> DataFrame:
    """The row of a matrix for each token id; ids without a row give none."""
    rows = read_table(spark, d, "token_vocab").select("token_id").join(read_table(spark, d, "embeddings"), F.col("token_id") == F.col("vec_id"))
    return rows.select("token_id", F.round(F.aggregate(F.transform("embedding", lambda v: v.cast("double")), F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query("""SELECT count(*) AS n_targets, round(avg(ln(list_sum(list_transform(e, lambda z: exp(z - list_max(e))))) + list_max(e) - e[label + 1]), 6) AS mean_nll
FROM (SELECT CASE WHEN label = 3 THEN -1 ELSE label END AS label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings) WHERE label <> -1""")
def ignored_targets(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss where one class is marked as not counted: neither in the sum nor in the count."""
    rows = read_table(spark, d, "embeddings").withColumn("y", F.when(F.col("label") == 3, scoring.IGNORED).otherwise(F.col("label"))).where(F.col("y") != scoring.IGNORED)
    return rows.agg(F.count("*").alias("n_targets"), F.round(F.avg(scoring.softmax_nll(F.col("embedding"), F.col("y"))), 6).alias("mean_nll"))


_LOG = """l AS (SELECT run_id, iter, split, CASE WHEN NOT isnan(loss) THEN loss END AS loss, lr, dt_ms, mfu, logged_at FROM loss_log),
c AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY run_id, iter, split ORDER BY logged_at DESC, loss NULLS LAST) = 1)"""


@query(f"WITH {_LOG} SELECT run_id, split, round(avg(loss), 9) AS mean_loss, count(loss) AS n FROM c GROUP BY run_id, split")
def loss_estimate(spark: SparkSession, d: str) -> DataFrame:
    return runs.loss_estimate(read_table(spark, d, "loss_log")).withColumn("mean_loss", F.round("mean_loss", 9))


@query(f"""WITH RECURSIVE {_LOG}, v AS (SELECT run_id, iter, loss, row_number() OVER (PARTITION BY run_id ORDER BY iter) AS k FROM c WHERE split = 'val' AND loss IS NOT NULL),
f AS (SELECT run_id, k, loss AS best, loss AS kept FROM v WHERE k = 1
    UNION ALL SELECT f.run_id, v.k, least(f.best, v.loss), CASE WHEN v.loss < f.kept OR v.iter % 250 = 0 THEN v.loss ELSE f.kept END FROM f JOIN v ON v.run_id = f.run_id AND v.k = f.k + 1)
SELECT run_id, arg_max(best, k) AS best_so_far, arg_max(kept, k) AS kept_best FROM f GROUP BY run_id""")
def best_loss(spark: SparkSession, d: str) -> DataFrame:
    return runs.best_losses(read_table(spark, d, "loss_log"))


@query(f"""WITH RECURSIVE {_LOG}, v AS (SELECT run_id, iter, mfu, row_number() OVER (PARTITION BY run_id ORDER BY iter) AS k FROM c WHERE split = 'train' AND mfu IS NOT NULL),
f AS (SELECT run_id, k, iter, -1.0::DOUBLE AS m FROM v WHERE k = 1
    UNION ALL SELECT f.run_id, v.k, v.iter, CASE WHEN v.k <= 5 THEN -1.0 WHEN f.m = -1.0 THEN v.mfu ELSE 0.9e0 * f.m + 0.1e0 * v.mfu END FROM f JOIN v ON v.run_id = f.run_id AND v.k = f.k + 1)
SELECT run_id, iter, round(m, 9) AS running_mfu FROM f""")
def mfu_ema(spark: SparkSession, d: str) -> DataFrame:
    return runs.mfu_average(read_table(spark, d, "loss_log")).withColumn("running_mfu", F.round("running_mfu", 9))


@query("SELECT run_id, iter, split, round(loss / 16, 9) AS micro_loss, round(loss / 16 * 16, 9) AS logged_loss FROM loss_log WHERE NOT isnan(loss)")
def logged_loss(spark: SparkSession, d: str) -> DataFrame:
    """The last micro-batch's share of a loss, scaled back for the log."""
    return read_table(spark, d, "loss_log").where("loss is not null and not isnan(loss)").select("run_id", "iter", "split", F.round(F.col("loss") / 16, 9).alias("micro_loss"), F.round(F.col("loss") / 16 * 16, 9).alias("logged_loss"))


@query("SELECT run_id, iter, split, loss, lr FROM loss_log WHERE iter % 50 = 0")
def evaluation_points(spark: SparkSession, d: str) -> DataFrame:
    return runs.evaluation_points(read_table(spark, d, "loss_log")).select("run_id", "iter", "split", "loss", "lr")


@query("""SELECT DISTINCT iter, round(CASE WHEN iter < 200 THEN 0.006e0 * (iter + 1) / 201e0 WHEN iter > 600000 THEN 6e-5
    ELSE 6e-5 + (1 + cos(pi() * ((iter - 200) / 599800e0))) * ((0.006e0 - 6e-5) / 2) END, 12) AS lr FROM loss_log""")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    its = read_table(spark, d, "loss_log").select("iter").distinct()
    return its.select("iter", F.round(scalars.learning_rate(F.col("iter"), 0.006), 12).alias("lr"))


@query("""SELECT run_id, iter, split, round((6 * 6960768 + 12 * 2 * 4 * 32 * 1024)::DOUBLE * 1024 * 192 / (dt_ms / 1000) / 312e12, 9) AS mfu_now FROM loss_log WHERE dt_ms > 0""")
def mfu_table(spark: SparkSession, d: str) -> DataFrame:
    flops = scalars.flops_per_token(F.lit(6960768), F.lit(2), F.lit(4), F.lit(128), F.lit(1024))
    now = scalars.utilisation(flops, F.lit(1024), F.lit(192), F.col("dt_ms") / 1000)
    return read_table(spark, d, "loss_log").where("dt_ms > 0").select("run_id", "iter", "split", F.round(now, 9).alias("mfu_now"))


@query("""SELECT ckpt_id, CASE WHEN val_loss IS NULL THEN NULL ELSE printf('%08.4fval_loss_%s_%s.pt', val_loss, model_name, replace(coalesce(author, 'N/A'), ' ', '')) END AS file_name FROM checkpoint_registry""")
def checkpoint_names(spark: SparkSession, d: str) -> DataFrame:
    return runs.checkpoint_names(read_table(spark, d, "checkpoint_registry"))


@query("""SELECT ckpt_id, run_id, row_number() OVER w AS place, row_number() OVER w <= 3 AS retained FROM checkpoint_registry WINDOW w AS (PARTITION BY run_id ORDER BY val_loss ASC NULLS LAST, path, ckpt_id)""")
def checkpoint_retention(spark: SparkSession, d: str) -> DataFrame:
    return runs.retention(read_table(spark, d, "checkpoint_registry"), 3, "run_id").withColumn("place", F.col("place").cast("long"))


@query("SELECT ckpt_id, string_split(path, '/')[1] AS folder, string_split(path, '/')[2] AS file FROM checkpoint_registry")
def checkpoint_paths(spark: SparkSession, d: str) -> DataFrame:
    parts = scalars.folder_and_file(F.col("path"))
    return read_table(spark, d, "checkpoint_registry").select("ckpt_id", parts.alias("p")).select("ckpt_id", F.col("p")[0].alias("folder"), F.col("p")[1].alias("file"))


_CONFIGS = ((50257, 128, 2, 1024), (50257, 768, 12, 1024), (1000, 64, 1, 128), (65, 384, 6, 256))


@query("""WITH c(vocab, width, layers, block) AS (VALUES """ + ", ".join(str(c) for c in _CONFIGS) + """),
p AS (SELECT *, CAST(vocab * width + block * width + layers * 12 * width * width AS BIGINT) AS decayed, CAST(layers * 13 * width + 2 * width AS BIGINT) AS not_decayed FROM c)
SELECT vocab, width, layers, block, decayed + not_decayed AS total, decayed + not_decayed AS trainable, decayed, not_decayed, decayed + not_decayed > 100000000 AS over_limit FROM p""")
def param_groups(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of decoders of several sizes, one of them over the limit."""
    own = ("vocab", "width", "layers", "block")
    rows = [(*c, *p) for c in _CONFIGS for p in runs.decoder_parameters(*c)]
    table = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in own) + ", name string, shape array<bigint>, requires_grad boolean, tied_to string")
    return runs.parameter_groups(table, 100_000_000, *own)


@query("SELECT run_id, count(DISTINCT iter) AS n_iters, format('{:,}', count(DISTINCT iter) * 196608) AS tokens FROM loss_log GROUP BY run_id")
def tokens_seen(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a run's distinct iterations; a step logged for two splits, or twice, counts once."""
    seen = runs.tokens_seen(read_table(spark, d, "loss_log"), runs.tokens_per_iteration(16, 1, 12, 1024))
    return seen.select("run_id", "n_iters", scalars.thousands(F.col("tokens")).alias("tokens"))


@query("""WITH g AS (SELECT unnest(range(0, 600001)) AS iter),
l AS (SELECT *, CASE WHEN iter < 200 THEN 0.006e0 * (iter + 1) / 201e0 WHEN iter > 600000 THEN 6e-5 ELSE 6e-5 + (1 + cos(pi() * ((iter - 200) / 599800e0))) * ((0.006e0 - 6e-5) / 2) END AS a,
    CASE WHEN iter < 1000 THEN 0.006e0 * (iter + 1) / 1001e0 WHEN iter > 300000 THEN 1e-5 ELSE 1e-5 + (1 + cos(pi() * ((iter - 1000) / 299000e0))) * ((0.006e0 - 1e-5) / 2) END AS b FROM g)
SELECT iter // 1000 AS thousand, count(*) AS n_steps, min(iter) AS first_step, max(iter) AS last_step, count(*) FILTER (iter % 50 = 0) AS n_evaluations, count(*) FILTER (iter % 250 = 0 AND iter > 0) AS n_saves,
    round(sum(a), 8) AS sum_lr, round(sum(b), 8) AS sum_short_lr, round(max(b), 10) AS max_short_lr FROM l GROUP BY 1""")
def training_steps(spark: SparkSession, d: str) -> DataFrame:
    """All 600,001 steps of a full run by thousands, under the schedule and under one whose floor comes earlier."""
    steps = runs.training_steps(spark, 0.006).withColumn("short", scalars.learning_rate(F.col("iter"), 0.006, 1000, 300_000, 1e-5))
    return steps.groupBy(F.floor(F.col("iter") / 1000).alias("thousand")).agg(
        F.count("*").alias("n_steps"), F.min("iter").alias("first_step"), F.max("iter").alias("last_step"), F.count_if("evaluates").alias("n_evaluations"), F.count_if("saves").alias("n_saves"),
        F.round(F.sum("lr"), 8).alias("sum_lr"), F.round(F.sum("short"), 8).alias("sum_short_lr"), F.round(F.max("short"), 10).alias("max_short_lr"),
    )


@query("""WITH s AS (SELECT run_id, iter, min(logged_at) AS seen FROM loss_log WHERE logged_at IS NOT NULL GROUP BY run_id, iter)
SELECT run_id, iter, round((epoch_us(seen) - epoch_us(lag(seen) OVER w)) / 1e6, 6) AS seconds, round((epoch_us(seen) - epoch_us(first(seen) OVER w)) / 1e6, 6) AS elapsed FROM s WINDOW w AS (PARTITION BY run_id ORDER BY iter)""")
def step_times(spark: SparkSession, d: str) -> DataFrame:
    return runs.step_times(read_table(spark, d, "loss_log")).select("run_id", "iter", F.round("seconds", 6).alias("seconds"), F.round("elapsed", 6).alias("elapsed"))


@query("""SELECT run_id, iter, split, CASE WHEN NOT isnan(loss) THEN round(loss, 9) END AS loss, lr, logged_at IS NOT NULL AS timed FROM loss_log
UNION ALL SELECT run_id, 600000 AS iter, 'val' AS split, round(min(loss), 9) AS loss, NULL AS lr, true AS timed FROM loss_log WHERE split = 'val' AND NOT isnan(loss) GROUP BY run_id""")
def metrics_append(spark: SparkSession, d: str) -> DataFrame:
    """A metrics table after two appends: the log, then a last row of each run's best val loss."""
    path = f"{scratch_root(spark)}/metrics-{uuid.uuid4().hex[:8]}"
    log = read_table(spark, d, "loss_log")
    runs.append_metrics(log.withColumn("logged_at", F.coalesce("logged_at", F.current_timestamp())), path)
    best = log.where("split = 'val' and loss is not null and not isnan(loss)").groupBy("run_id").agg(F.min("loss").alias("loss"))
    runs.append_metrics(best.select("run_id", F.lit(600_000).alias("iter"), F.lit("val").alias("split"), "loss"), path)
    loss = F.when(~F.isnan("loss"), F.round("loss", 9))
    return spark.read.parquet(path).select("run_id", "iter", "split", loss.alias("loss"), "lr", F.col("logged_at").isNotNull().alias("timed"))


@query("""WITH r AS (SELECT ckpt_id, run_id, string_split(path, '/')[1] || '/' || printf('%08.4fval_loss_%s_%s.pt', val_loss, model_name, replace(coalesce(author, 'N/A'), ' ', '')) AS path, val_loss FROM checkpoint_registry WHERE val_loss IS NOT NULL)
SELECT ckpt_id, run_id, path, round(val_loss, 9) AS val_loss, row_number() OVER (PARTITION BY run_id ORDER BY val_loss, path, ckpt_id) <= 3 AS retained FROM r""")
def registry_append(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints saved under the names their losses give, appended to a registry run by run, with what is retained."""
    path = f"{scratch_root(spark)}/registry-{uuid.uuid4().hex[:8]}"
    saved = read_table(spark, d, "checkpoint_registry").where("val_loss is not null")
    named = saved.join(runs.checkpoint_names(saved), "ckpt_id").withColumn("path", F.concat_ws("/", scalars.folder_and_file(F.col("path"))[0], "file_name")).drop("file_name")
    for odd in (0, 1):  # two savers, one after the other
        runs.append_checkpoints(named.where(F.pmod("ckpt_id", F.lit(2)) == odd), path)
    back = spark.read.parquet(path)
    return runs.retention(back, 3, "run_id").join(back.select("ckpt_id", "path", F.round("val_loss", 9).alias("val_loss")), "ckpt_id").select("ckpt_id", "run_id", "path", "val_loss", "retained")


@query("SELECT i, len(range(i + 1, 1024)) AS n_masked, CASE WHEN i < 1023 THEN i + 1 END AS first_masked, CASE WHEN i < 1023 THEN CAST(1023 AS BIGINT) END AS last_masked FROM (SELECT unnest(range(1024)) AS i)")
def causal_mask(spark: SparkSession, d: str) -> DataFrame:
    """The places each place of a block must not see: how many, the first and the last."""
    return blocks.causal_mask(spark, blocks.BLOCK).select("i", F.size("masked").cast("long").alias("n_masked"), F.array_min("masked").alias("first_masked"), F.array_max("masked").alias("last_masked"))


@query("""WITH t AS (SELECT ckpt_id, '{"author":"' || coalesce(author, 'N/A') || '","vocab_size":' || (50000 + ckpt_id) || ',"path":"' || path || '","block_size":1024}' AS j FROM checkpoint_registry)
SELECT ckpt_id, CAST(i AS BIGINT) AS place, json_keys(j)[i] AS name, json_extract_string(j, '$.' || json_keys(j)[i]) AS value FROM (SELECT ckpt_id, j, unnest(range(1, len(json_keys(j)) + 1)) AS i FROM t)""")
def config_values(spark: SparkSession, d: str) -> DataFrame:
    """Keys and values of JSON configs in the order they stand there, by Spark's own JSON functions."""
    text = F.concat(F.lit('{"author":"'), F.coalesce("author", F.lit("N/A")), F.lit('","vocab_size":'), (F.col("ckpt_id") + 50000).cast("string"), F.lit(',"path":"'), "path", F.lit('","block_size":1024}'))
    rows = read_table(spark, d, "checkpoint_registry").select("ckpt_id", text.alias("j")).select("ckpt_id", "j", F.posexplode(F.json_object_keys("j")).alias("at", "name"))
    return rows.select("ckpt_id", (F.col("at") + 1).cast("long").alias("place"), "name", F.expr("get_json_object(j, concat('$.', name))").alias("value"))
