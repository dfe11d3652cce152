"""Term statistics and sparse similarity."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import term_text, weighted_terms
from loomwright.operators.ranking import top_per
from loomwright.operators.skew import spread_join
from loomwright.session import cut, parallelism

#: Vectors of a block of queries, and of rows; a task holds one block of each.
QUERIES, ROWS = 2048, 4096
#: Vectors of rows, and terms, up to which ``nearest_texts`` gives all tasks one index of the rows.
MOST_ROWS, MOST_TERMS = 50_000, 1_000_000
#: Products of a query's and a row's vector that are held at once.
PRODUCTS = 2**16
#: Terms that as many rows have, per query, are taken for all rows at once, in a table of so many numbers.
FREQUENT, DENSE = 20, 2**17


def term_frequencies(df: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id_col, term, tf): shares of a row's weighted terms(term, weight). A row without terms gives none."""
    total = F.aggregate("_t", F.lit(0.0), lambda s, x: s + x["weight"])
    # explode_outer: from explode, Spark infers a filter for which it works out the terms twice
    rows = df.select(id_col, terms.alias("_t")).select(id_col, total.alias("_n"), F.explode_outer("_t").alias("_x"))
    return rows.where("_x is not null").groupBy(id_col, "_x.term").agg((F.sum("_x.weight") / F.max("_n")).alias("tf"))


def inverse_document_frequency(tf: DataFrame, id_col: str) -> DataFrame:
    """(term, df, idf) with idf = ln((n + 1) / (df + 1)) + 1 over the n rows that have terms."""
    n = tf.select(id_col).distinct().count()
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1)


def sparse_cosine(queries: DataFrame, rows: DataFrame, idf: DataFrame, query_id: str, row_id: str) -> DataFrame:
    """(query_id, row_id, similarity): TF-IDF cosine of all pairs that share a term; every other pair of rows with terms
    has 0 and is not written. Terms without idf weigh 1, the result is at most 1.

    The term join is the only way pairs arise: a query's terms meet the inverted index of the rows, never all rows. The rows
    of a frequent term spread over tasks by a salt, for which the queries' terms are repeated.
    """
    weigh = lambda tf, name: tf.join(idf.select("term", "idf"), "term", "left").withColumn(name, F.col("tf") * F.coalesce("idf", F.lit(1.0))).drop("tf", "idf")
    q, r = weigh(queries, "wq"), weigh(rows, "wr")
    q_norm = q.groupBy(query_id).agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("nq"))
    r_norm = r.groupBy(row_id).agg(F.sqrt(F.sum(F.col("wr") * F.col("wr"))).alias("nr"))
    dots = spread_join(r, q, ["term"], F.xxhash64(row_id)).groupBy(query_id, row_id).agg(F.sum(F.col("wq") * F.col("wr")).alias("dot"))
    joined = dots.join(q_norm, query_id).join(r_norm, row_id)
    return joined.select(query_id, row_id, F.least(F.lit(1.0), F.col("dot") / (F.col("nq") * F.col("nr"))).alias("similarity"))


def idf_of_texts(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """As ``inverse_document_frequency`` of ``term_frequencies``, from docs partitioned by ``id_col``, whose terms are never moved:
    those of an id with one row are distinct within the row, and only ids with several rows sort theirs. Null ids don't count in n."""
    rows = docs.select(id_col, F.count(F.lit(1)).over(Window.partitionBy(id_col)).alias("_rows"), terms["term"].alias("_t"))
    once = rows.where("_rows = 1").select(id_col, F.posexplode_outer(F.array_distinct("_t")).alias("_pos", "term")).where("term is not null")
    more = rows.where("_rows > 1").select(id_col, F.explode("_t").alias("term")).distinct()
    more = more.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("term")) - 1).alias("_pos"), "term")
    first = F.count_if((F.col("_pos") == 0) & F.col(id_col).isNotNull())  # an id's terms have one first
    counts = cut(once.unionByName(more).groupBy("term").agg(F.count(F.lit(1)).alias("df"), first.alias("_n")))
    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first().n
    return counts.select("term", "df", (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))


def nearest(queries: DataFrame, rows: DataFrame, idf: DataFrame, query_id: str, row_id: str, k: int, digits: int, query_block: int = QUERIES, row_block: int = ROWS) -> DataFrame:
    """(query_id, row_id, similarity, rank): for each query of queries(query_id, term, tf), the k rows with the highest
    ``sparse_cosine``, rounded to ``digits``; equal ones by row_id. Rows that share no term are not among them.

    Ids with equal terms and frequencies are one vector; only the first k ids of a rows' vector can be among any query's k.
    Distinct vectors meet in blocks, each pair of blocks in one task, by an inverted index of the block's rows; what leaves the task is
    k rows per query. So pairs are neither shuffled nor written, however many share a term.
    """
    q_vectors, r_vectors = cut(_vectors(queries, query_id)), _vectors(rows, row_id)
    numbered = lambda df: cut(df.withColumn("_v", F.monotonically_increasing_id()))
    q = numbered(q_vectors.select("_terms").distinct())
    kept = top_per(r_vectors, ["_terms"], [F.asc(row_id)], k)
    r = numbered(kept.groupBy("_terms").agg(F.array_sort(F.collect_list(row_id)).alias("_ids")))
    least = 2 * parallelism(queries.sparkSession)
    q_blocks = _blocks(_weighed(q, idf), query_block, least, "_queries")
    r_blocks = _blocks(_weighed(r, idf).join(r.select("_v", "_ids"), "_v"), row_block, 1, "_rows")
    kind = rows.schema[row_id].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, others in zip(b.column("_queries"), b.column("_rows")):
                yield _best_of_block(some.values, others.values, k, digits)

    found = q_blocks.crossJoin(r_blocks).mapInArrow(best, f"_v long, _id {kind}, similarity double")
    ranked = top_per(found, ["_v"], [F.desc("similarity"), F.asc("_id")], k)
    ids = q_vectors.join(q, "_terms").select(query_id, "_v")
    return ids.join(ranked, "_v").select(query_id, F.col("_id").alias(row_id), "similarity", "rank")


def nearest_texts(docs: DataFrame, rows: DataFrame, doc_id: str, row_id: str, text: str, k: int, digits: int, most_rows: int = MOST_ROWS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(doc_id, row_id, similarity, rank): as ``nearest`` for the weighted terms of all docs, with their own idf. docs has the texts of an
    id in one place and rows may share an id; rows of the same id add up. Null ids count in df but have no result.

    Ids whose texts have the same terms in the same order are one query. Queries are not moved after that: each task finds
    their k rows in an inverted index of the distinct rows' vectors, which is sent to all tasks while it is small; beyond
    ``most_rows`` vectors or ``most_terms`` terms, ``nearest`` works out the same in blocks. 128 bits stand for an id's texts.
    """
    spark = docs.sparkSession
    ids = _texts_of(docs, doc_id, text)
    units = ids.groupBy("_texts").agg(F.count(F.lit(1)).alias("_n"), F.count(doc_id).alias("_ids"))
    in_texts = F.transform("_texts", lambda t: weighted_terms(t))
    whole = F.transform("_t", lambda t: F.array_join(F.filter(t, lambda x: x["weight"] == 1)["term"], " "))  # terms have no spaces
    units = units.select("_texts", "_n", "_ids", in_texts.alias("_t")).withColumns({"_whole": whole, "_part": F.transform("_t", lambda t: F.filter(t, lambda x: x["weight"] != 1))})
    units = cut(units.drop("_t").withColumn("_u", F.monotonically_increasing_id()).withColumns(_key("_texts")))
    in_whole = F.filter(F.split(F.array_join("_whole", " "), " "), lambda t: t != "")
    distinct = F.array_distinct(F.concat(in_whole, F.flatten("_part")["term"]))
    each = units.select("_n", "_ids", F.posexplode_outer(distinct).alias("_pos", "term")).where("term is not null")
    counts = cut(each.groupBy("term").agg(F.sum("_n").alias("df"), F.sum(F.when(F.col("_pos") == 0, F.col("_ids")).otherwise(0)).alias("_first")))
    n, n_terms = counts.agg(F.coalesce(F.sum("_first"), F.lit(0)), F.count(F.lit(1))).first()  # an id's terms have one first
    idf = counts.select("term", "df", (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))
    r_units = _first_ids(_texts_of(rows.where(F.col(row_id).isNotNull()), row_id, text), "_texts", row_id, k)
    r_units = cut(r_units.withColumn("_u", F.monotonically_increasing_id()))
    vectors = _vectors(_frequencies_of(r_units), "_u").join(r_units.select("_u", F.explode("_ids").alias(row_id)), "_u")
    r = cut(_first_ids(vectors, "_terms", row_id, k).withColumn("_v", F.monotonically_increasing_id()))
    kind = rows.schema[row_id].dataType.simpleString()
    if n_terms <= most_terms and r.count() <= most_rows:
        index = spark.sparkContext.broadcast(_Index(idf.toArrow(), _weighed(r, idf).join(r.select("_v", "_ids"), "_v").toArrow()))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield index.value.best(b, k, digits)

        found = units.select("_k1", "_k2", "_whole", "_part").mapInArrow(best, f"_k1 long, _k2 long, _best array<struct<_id:{kind},similarity:double>>")
    else:
        r_each = r.select("_terms", F.explode("_ids").alias(row_id)).select(row_id, F.inline("_terms"))
        ranked = nearest(_frequencies_of(units), r_each, idf, "_u", row_id, k, digits)
        listed = F.array_sort(F.collect_list(F.struct("rank", F.col(row_id).alias("_id"), "similarity")))
        ranked = ranked.groupBy("_u").agg(F.transform(listed, lambda x: F.struct(x["_id"], x["similarity"])).alias("_best"))
        found = units.join(ranked, "_u").select("_k1", "_k2", "_best")
    wanted = ids.where(F.col(doc_id).isNotNull()).select(doc_id, *[c.alias(name) for name, c in _key("_texts").items()])
    joined = wanted.join(found, ["_k1", "_k2"]).select(doc_id, F.posexplode("_best").alias("_pos", "_x"))
    return joined.select(doc_id, F.col("_x._id").alias(row_id), "_x.similarity", (F.col("_pos") + 1).cast("long").alias("rank"))


def _texts_of(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, _texts): what the terms of each id's texts depend on, sorted; ids without a text give none."""
    return df.where(F.col(text).isNotNull()).select(id_col, term_text(F.col(text)).alias("_text")).groupBy(id_col).agg(F.array_sort(F.collect_list("_text")).alias("_texts"))


def _key(name: str) -> dict[str, Column]:
    return {"_k1": F.xxhash64(name), "_k2": F.xxhash64(F.lit(""), name, F.lit(1))}


def _first_ids(df: DataFrame, key: str, id_col: str, k: int) -> DataFrame:
    """(key, _ids): the first k ids of each key."""
    return top_per(df, [key], [F.asc(id_col)], k).groupBy(key).agg(F.array_sort(F.collect_list(id_col)).alias("_ids"))


def _frequencies_of(units: DataFrame) -> DataFrame:
    return term_frequencies(units.select("_u", F.explode("_texts").alias("_text")), "_u", weighted_terms(F.col("_text")))


class _Index:
    """An inverted index of the vectors of rows (_v, _w, _ids), with a dense table for frequent terms; and (term, df, idf)."""

    def __init__(self, idf: pa.Table, rows: pa.Table):
        rows = rows.take(np.random.default_rng(0).permutation(len(rows)))  # like rows apart, so that parts of them have like bests
        self.terms, self.idf = idf["term"].combine_chunks(), idf["idf"].to_numpy()
        term, w, of, norm = _flat(pa.StructArray.from_arrays([rows["_w"].combine_chunks()], ["_w"]))
        code = pc.fill_null(pc.index_in(term, value_set=self.terms), -1).to_numpy()  # a term that no query has is only in the norm
        by_term = np.argsort(code, kind="stable")[np.count_nonzero(code < 0) :]
        self.holders, self.weights = of[by_term], w[by_term] / norm[of[by_term]]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(code[code >= 0], minlength=len(self.terms)))])
        self.n = len(norm)
        df = idf["df"].to_numpy()
        often = df / max(1, df.max(initial=0)) * np.diff(self.starts)
        frequent = np.argsort(-often, kind="stable")[: DENSE // max(1, self.n)]
        frequent = frequent[often[frequent] > FREQUENT]
        self.line, self.dense = np.full(len(self.terms), -1), np.zeros((len(frequent), self.n))
        self.line[frequent] = np.arange(len(frequent))
        for i, c in enumerate(frequent):
            held = slice(self.starts[c], self.starts[c + 1])
            self.dense[i, self.holders[held]] = self.weights[held]
        lists = rows["_ids"].combine_chunks()
        ids = lists.flatten()
        order = pc.sort_indices(ids).to_numpy()  # strings by bytes, as SQL does
        self.ids, self.rank = ids.take(order), np.argsort(order)
        self.n_ids = lists.value_lengths().to_numpy().astype(np.int64)
        self.first_id = np.cumsum(self.n_ids) - self.n_ids

    def best(self, batch: pa.RecordBatch, k: int, digits: int) -> pa.RecordBatch:
        """The k rows of each query of (_k1, _k2, _whole, _part), per text the terms of weight 1 and the others; those without any are left out."""
        of, code, x, norm = self._weighed(batch.column("_whole"), batch.column("_part"))
        held = self.starts[code + 1] > self.starts[code]
        of, code, x = of[held], code[held], x[held]
        step = max(1, PRODUCTS // max(1, self.n))
        at = np.searchsorted(of, np.arange(0, len(norm) + step, step))
        parts = [self._of_some(of[a:b] - i * step, code[a:b], x[a:b], norm[i * step : (i + 1) * step], k, digits) for i, (a, b) in enumerate(zip(at, at[1:])) if b > a]
        firsts = [i * step for i, (a, b) in enumerate(zip(at, at[1:])) if b > a]
        q = np.concatenate([np.zeros(0, np.int64), *[p[0] + i for p, i in zip(parts, firsts)]])
        rank = np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]])
        s = np.concatenate([np.zeros(0), *[p[2] for p in parts]])
        n = np.bincount(q, minlength=len(norm))
        some = np.flatnonzero(n)
        found = pa.StructArray.from_arrays([self.ids.take(pa.array(rank)), pa.array(s)], ["_id", "similarity"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[some])]), pa.int32()), found)
        return pa.RecordBatch.from_arrays([batch.column("_k1").take(pa.array(some)), batch.column("_k2").take(pa.array(some)), lists], ["_k1", "_k2", "_best"])

    def _weighed(self, whole: pa.ListArray, part: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per term of a query, in the queries' order: the query, the term's code and weight; and the queries' lengths."""
        n = len(whole)
        of_text = np.repeat(np.arange(n), whole.value_lengths().to_numpy())
        split, parts = pc.split_pattern(whole.flatten(), " "), part.flatten()
        owner = lambda lists: np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        code = [pc.fill_null(pc.index_in(x, value_set=self.terms), -1).to_numpy() for x in (split.flatten(), parts.flatten().field("term"))]
        text, code, w = np.concatenate([owner(split), owner(parts)]), np.concatenate(code), np.concatenate([np.ones(len(code[0])), parts.flatten().field("weight").to_numpy()])
        text, code, w = text[code >= 0], code[code >= 0], w[code >= 0]  # a text without terms has the empty one
        pairs, which = np.unique(of_text[text] * len(self.terms) + code, return_inverse=True)
        of, code = np.divmod(pairs, max(1, len(self.terms)))
        total = np.zeros(len(pairs))  # of the texts with the term, the most that one has
        np.maximum.at(total, which, np.bincount(text, w, len(of_text))[text])
        x = np.bincount(which, w, len(pairs)) / total * self.idf[code]
        return of, code, x, np.sqrt(np.bincount(of, x * x, n))

    def _of_some(self, of: np.ndarray, code: np.ndarray, x: np.ndarray, norm: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a few queries, by their terms: query, rank of the row's id, and similarity, the best first."""
        n, line = self.n, self.line[code]
        frequent = np.zeros((len(norm), len(self.dense)))
        frequent[of[line >= 0], line[line >= 0]] = x[line >= 0]
        of, code, x = of[line < 0], code[line < 0], x[line < 0]
        start = self.starts[code]
        each = self.starts[code + 1] - start
        at = np.arange(each.sum()) + np.repeat(start - np.cumsum(each) + each, each)
        dot = frequent @ self.dense
        dot += np.bincount(np.repeat(of * n, each) + self.holders[at], np.repeat(x, each) * self.weights[at], len(norm) * n).reshape(-1, n)
        least = np.full(len(norm), 0.0)
        if n > k:  # of the best of some parts of the rows the k-th: that of all is no less; what may round to as much stays
            parts = min(n, 16 * k)
            least = np.partition(np.maximum.reduceat(dot, np.arange(parts) * n // parts, 1), -k, 1)[:, -k] - norm * 10.0**-digits
        q, v = np.divmod(np.flatnonzero(dot >= np.maximum(least, np.finfo(float).tiny)[:, None]), n)
        units, n_ids = _units(np.minimum(1.0, dot[q, v] / norm[q]), digits), self.n_ids[v]
        ids = np.arange(n_ids.sum()) + np.repeat(self.first_id[v] - np.cumsum(n_ids) + n_ids, n_ids)
        q, units, rank = np.repeat(q, n_ids), np.repeat(units, n_ids), self.rank[ids]
        order = np.lexsort((rank, -units, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        first = place < k
        return q[first], rank[order][first], units[order][first] / 10.0**digits


def _vectors(tf: DataFrame, id_col: str) -> DataFrame:
    """(id_col, _terms): the sorted terms and frequencies of each id but null."""
    return tf.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("_terms"))


def _weighed(vectors: DataFrame, idf: DataFrame) -> DataFrame:
    """(_v, _w) with the weights of _terms; terms without idf weigh 1."""
    each = vectors.select("_v", F.inline("_terms")).join(idf.select("term", "idf"), "term", "left")
    weight = F.struct("term", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    return each.groupBy("_v").agg(F.array_sort(F.collect_list(weight)).alias("_w"))


def _blocks(vectors: DataFrame, size: int, least: int, name: str) -> DataFrame:
    """Arrays of about ``size`` vectors, in ``least`` rows or more where there are as many vectors."""
    vectors = cut(vectors)
    n = vectors.count()
    blocks = max(-(-n // size), min(least, n), 1)
    packed = vectors.groupBy(F.pmod(F.xxhash64("_v"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct(*vectors.columns)).alias(name))
    return packed.select(name).repartition(blocks)


def _flat(vectors: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's vectors: terms and weights one after the other, the vector of each, and the vectors' lengths."""
    lists = vectors.field("_w")
    flat, of = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    w = flat.field("w").to_numpy()
    return flat.field("term"), w, of, np.sqrt(np.bincount(of, w * w, len(lists)))


def _units(x: np.ndarray, digits: int) -> np.ndarray:
    """x in units of the last of ``digits``, rounded half up by its decimal notation as SQL's round does."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = int(Decimal(repr(float(x[i]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _best_of_block(queries: pa.StructArray, rows: pa.StructArray, k: int, digits: int) -> pa.RecordBatch:
    (r_term, r_w, r_of, r_norm), (q_term, q_w, q_of, q_norm) = _flat(rows), _flat(queries)
    coded = r_term.dictionary_encode()
    code = coded.indices.to_numpy()
    by_term = np.argsort(code, kind="stable")
    holders, weights = r_of[by_term], r_w[by_term]
    starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))])
    wanted = pc.fill_null(pc.index_in(q_term, value_set=coded.dictionary), -1).to_numpy()
    known = wanted >= 0
    wanted, q_w, ends = wanted[known], q_w[known], np.cumsum(np.bincount(q_of[known], minlength=len(queries)))
    numbers, ids = queries.field("_v").to_numpy(), rows.field("_ids")
    out_v, out_id, out_s = [], [], []
    for j, end in enumerate(ends):
        at = range(ends[j - 1] if j else 0, end)
        if not at:
            continue
        places = [slice(starts[wanted[i]], starts[wanted[i] + 1]) for i in at]
        dot = np.bincount(np.concatenate([holders[p] for p in places]), np.concatenate([weights[p] * q_w[i] for i, p in zip(at, places)]), len(rows))
        sharing = np.flatnonzero(dot)  # weights are above 0
        s = np.minimum(1.0, dot[sharing] / (q_norm[j] * r_norm[sharing]))
        if len(s) > k:  # what may round to as much as the k-th
            may = s >= np.partition(s, -k)[-k] - 10.0**-digits
            sharing, s = sharing[may], s[may]
        units = _units(s, digits)
        if len(s) > k:
            may = units >= np.partition(units, -k)[-k]
            sharing, units = sharing[may], units[may]
        each = sorted((-u, x) for u, r in zip(units.tolist(), sharing.tolist()) for x in ids[r].as_py())[:k]
        out_v += [numbers[j]] * len(each)
        out_id += [x for _, x in each]
        out_s += [-u / 10.0**digits for u, _ in each]
    return pa.RecordBatch.from_arrays([pa.array(out_v, pa.int64()), pa.array(out_id, ids.type.value_type), pa.array(out_s, pa.float64())], ["_v", "_id", "similarity"])
