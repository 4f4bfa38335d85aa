"""Feature maps and texts as sparse vectors: two estimators and the lookup of names behind them."""

import uuid
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import as_column, opaque
from ..session import BROADCAST_ROW_LIMIT, materialize, shared_dir
from .ordering import with_row_index


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _sparse_vectors(rows: int, width: int, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> pa.Array:
    """Sparse vectors from (row, index, value) entries sorted by row and index."""
    offsets = _offsets(np.bincount(row, minlength=rows))
    return pa.StructArray.from_arrays(
        [
            pa.array(np.zeros(rows, dtype=np.int8)), pa.array(np.full(rows, width, dtype=np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(index.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float64))),
        ],
        names=["type", "size", "indices", "values"],
    )


def placed(lists: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, vocabulary index and position of each known name in an array column."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lengths)
    index = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
    known = np.flatnonzero(index >= 0)
    return row[known], index[known].astype(np.int64), known


def _dot(rows: int, row: np.ndarray, value: np.ndarray) -> pa.Array:
    """Sums of the values by row, added up in their order."""
    return pa.array(np.bincount(row, value, minlength=rows).astype(float))


def map_dot(features, table: dict[str, float]) -> Column:
    """For a map name → number, the sum of the numbers times the names' values in `table`; whatever is unknown or null counts 0."""
    known = {n: v for n, v in table.items() if v is not None}
    names, weights = pa.array(list(known), pa.string()), np.array([*known.values(), 0.0])

    @F.arrow_udf("double")
    def dot(keys: pa.Array, values: pa.Array) -> pa.Array:
        row, index, at = placed(keys, names)
        numbers = values.flatten()
        product = numbers.to_numpy(zero_copy_only=False)[at] * weights[index]
        if numbers.null_count:
            product[pc.is_null(numbers).to_numpy(zero_copy_only=False)[at]] = 0.0
        return _dot(len(keys), row, product)

    return opaque(dot)(F.map_keys(features), F.map_values(features))


def _ordered(keys: pa.Array, values: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, vocabulary index and number of each known name, sorted by row and index."""
    row, index, known = placed(keys, names)
    order = np.argsort(row * max(1, len(names)) + index, kind="stable")
    return row[order], index[order], values.flatten().to_numpy(zero_copy_only=False)[known[order]]


class _HasVocabulary(Params):
    vocabulary = Param(Params._dummy(), "vocabulary", "names in index order", TypeConverters.toListString)

    def getVocabulary(self) -> list[str]:
        return self.getOrDefault(self.vocabulary)


class SparseFeatureVectorizer(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the sorted distinct names of a map<string,double> column.

    Up to `most` names are held by the model; more stay in a table in shared storage, numbered by ranges of names.
    """

    most = Param(Params._dummy(), "most", "names the model holds itself", TypeConverters.toInt)

    def __init__(self, inputCol: str = "features", outputCol: str = "feature_vector", most: int = BROADCAST_ROW_LIMIT):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, most=most)

    def _fit(self, dataset: DataFrame) -> "SparseFeatureVectorizerModel":
        # `explode` would add a filter on the map's size that computes the map a second time.
        names = dataset.select(F.explode_outer(F.map_keys(self.getInputCol())).alias("name")).filter("name IS NOT NULL").distinct()
        model = SparseFeatureVectorizerModel(self.getInputCol(), self.getOutputCol())
        most = self.getOrDefault(self.most)
        first = names.limit(most + 1).collect()
        if len(first) <= most:
            return model._set(vocabulary=sorted(r[0] for r in first))
        numbered = with_row_index(names, ["name"], "index")
        path = f"{shared_dir(dataset.sparkSession)}/models/{uuid.uuid4().hex}/names"
        numbered.write.parquet(path)
        return model._set(table=path, size=dataset.sparkSession.read.parquet(path).count())


class SparseFeatureVectorizerModel(
    Model, HasInputCol, HasOutputCol, _HasVocabulary, DefaultParamsReadable, DefaultParamsWritable
):
    """Sparse vectors over the learned names; unseen names are ignored."""

    table = Param(Params._dummy(), "table", "where the numbered names lie, if the model does not hold them", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "names in the table", TypeConverters.toInt)

    def __init__(self, inputCol: str = "features", outputCol: str = "feature_vector"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def names(self, spark: SparkSession) -> DataFrame:
        """(name, index) of all learned names."""
        if self.isSet(self.table):
            return spark.read.schema("name string, index long").parquet(self.getOrDefault(self.table))
        return spark.createDataFrame([(n, i) for i, n in enumerate(self.getVocabulary())], "name string, index long")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source = F.col(self.getInputCol())
        if self.isSet(self.table):
            return self._joined(dataset)
        names = pa.array(self.getVocabulary(), pa.string())

        @F.arrow_udf(VectorUDT())
        def to_vector(keys: pa.Array, values: pa.Array) -> pa.Array:
            return _sparse_vectors(len(keys), len(names), *_ordered(keys, values, names))

        return dataset.withColumn(self.getOutputCol(), opaque(to_vector)(F.map_keys(source), F.map_values(source)))

    def products(self, weights: np.ndarray) -> Column | None:
        """Each row's vector times `weights`, without a column of vectors; none if the names lie in a table."""
        if self.isSet(self.table):
            return None
        names = pa.array(self.getVocabulary(), pa.string())

        @F.arrow_udf("double")
        def dot(keys: pa.Array, values: pa.Array) -> pa.Array:
            row, index, value = _ordered(keys, values, names)
            return _dot(len(keys), row, value * weights[index])

        return opaque(dot)(F.map_keys(self.getInputCol()), F.map_values(self.getInputCol()))

    def _joined(self, dataset: DataFrame) -> DataFrame:
        """As _transform, by a join of the rows' names with the table of names."""
        width = self.getOrDefault(self.size)

        @F.arrow_udf(VectorUDT())
        def to_vector(index: pa.Array, value: pa.Array) -> pa.Array:
            lengths = pc.fill_null(pc.list_value_length(index), 0).to_numpy(zero_copy_only=False)
            return _sparse_vectors(
                len(index), width, np.repeat(np.arange(len(index)), lengths), index.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False))

        # Written once, so that both readers see the same row numbers.
        rows = materialize(dataset.withColumn("_row", F.monotonically_increasing_id()))
        entries = rows.select("_row", F.explode(self.getInputCol()).alias("name", "_value"))
        # A name may stand in most rows; its entries are spread over all tasks only if the smaller side can be sent, else AQE splits it.
        cells = entries.join(self.names(rows.sparkSession), "name").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("index", "_value"))).alias("_cells"))
        none = F.array().cast("array<struct<index:bigint,_value:double>>")
        joined = rows.join(cells, "_row", "left").withColumn("_cells", F.coalesce("_cells", none))
        return joined.withColumn(self.getOutputCol(), opaque(to_vector)(F.col("_cells.index"), F.col("_cells._value"))).drop("_row", "_cells")


TOKEN = r"([\p{L}\p{N}_]{2,})"


def words(text) -> Column:
    """Lower-case words of two or more characters."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(TOKEN), F.lit(1))


def ngrams(text) -> Column:
    """Lower-case words of two or more characters, then all pairs of neighbors."""
    found = words(text)
    pairs = F.greatest(F.size(found) - 1, F.lit(0))
    neighbors = F.zip_with(
        F.slice(found, F.lit(1), pairs), F.slice(found, F.lit(2), pairs), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.concat(found, neighbors)


def term_statistics(df: DataFrame, text: str) -> DataFrame:
    """Corpus count and document count per term."""
    return _counted_terms(df, text).filter(F.col("term").isNotNull())


# Words whose terms a task sorts and sums at once; a longer text is summed alone. The cube, which bounds the numbers sorted, must stay below 2^63.
SUMMED_WORDS = 2_000_000
# Counts that a task builds and sends at once, for terms and parts together.
SUMMED_NUMBERS = 2_000_000


def _word_runs(batches, most: int):
    """The rows of `batches` in runs of about `most` words of their first column, a list of words; no row is cut."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
        begin, before = 0, 0
        while begin < len(ends):
            end = max(int(np.searchsorted(ends, before + most - size, "right")), begin if held else begin + 1)
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                size += int(ends[end - 1]) - before
                begin, before = end, int(ends[end - 1])
            if begin < len(ends):
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _term_sums(lists: pa.Array, inside: np.ndarray, most: int):
    """(terms, counts by part, documents by part) of lists of words, about `most` numbers at a time; `inside` says for each list and part whether it counts there."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = lengths > 0
    inside = inside[filled]
    row = np.repeat(np.arange(len(inside)), lengths[filled])
    coded = lists.flatten().dictionary_encode()
    names, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    near = np.flatnonzero(row[1:] == row[:-1])
    many, rows = max(1, len(names)), max(1, len(inside))
    # One number per term and row: below `many` a word, above it a pair.
    cells = np.concatenate([word * rows + row, (many + word[near] * many + word[near + 1]) * rows + row[near]])
    del coded, row, word, near
    cells.sort()
    at = np.flatnonzero(np.diff(cells, prepend=-1))
    count, cells = np.diff(at, append=len(cells)), cells[at]
    del at
    first = np.flatnonzero(np.diff(cells // rows, prepend=-1))
    step, begin = max(1, most // inside.shape[1]), 0
    while begin < len(first):
        # Cells of whole terms: a term stands in no more of them than there are rows.
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + step, "right")) - 1) if first[begin] + step < len(cells) else len(first)
        held = slice(first[begin], first[end] if end < len(first) else len(cells))
        starts = first[begin:end] - first[begin]
        term, row = np.divmod(cells[held], rows)
        times = count[held]
        counts, documents = np.zeros((2, len(starts), inside.shape[1]), np.int64)
        for j, part in enumerate(inside.T):
            within = part[row]
            counts[:, j] = np.add.reduceat(times * within, starts)
            documents[:, j] = np.add.reduceat(within.astype(np.int64), starts)
        term = term[starts]
        left, right = np.divmod(term[term >= many] - many, many)
        pairs = pc.binary_join_element_wise(names.take(pa.array(left)), names.take(pa.array(right)), " ")
        yield pa.concat_arrays([names.take(pa.array(term[term < many])), pairs]), counts, documents
        begin = end


def _counted_terms(df: DataFrame, text: str, parts: list[Column] | None = None, most: int = SUMMED_WORDS) -> DataFrame:
    """Corpus count and document count per term; the null term stands for the document itself.

    With `parts`, conditions on the rows, both are arrays of one count per part.

    Each task numbers the words of some rows and sums their terms as numbers; only terms that differ are
    built as text, and one shuffle of these sums gives both counts.
    """
    width = 1 if parts is None else len(parts)
    inside = F.array(*(F.coalesce(part, F.lit(False)) for part in (parts or [F.lit(True)])))
    schema = T.StructType([
        T.StructField("term", T.StringType()), *(T.StructField(f"_{kind}{j}", T.LongType()) for kind in "nd" for j in range(width))])

    def add_up(batches):
        for run in _word_runs(batches, most):
            within = run.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            rows = within.sum(0, dtype=np.int64)[None]
            for terms, counts, documents in chain([(pa.nulls(1, pa.string()), rows, rows)], _term_sums(run.column(0), within, SUMMED_NUMBERS)):
                sums = (pa.array(np.ascontiguousarray(s[:, j])) for s in (counts, documents) for j in range(width))
                yield pa.RecordBatch.from_arrays([terms, *sums], schema.fieldNames())

    summed = df.select(words(text).alias("words"), inside.alias("inside")).mapInArrow(add_up, schema)
    counted = summed.groupBy("term").agg(*(F.sum(c).alias(c) for c in schema.fieldNames()[1:]))
    both = ((name, [F.col(f"_{kind}{j}") for j in range(width)]) for name, kind in (("corpus_count", "n"), ("doc_count", "d")))
    return counted.select("term", *((cols[0] if parts is None else F.array(*cols)).alias(name) for name, cols in both))


def fold_vocabularies(df: DataFrame, text: str, training: list[Column], max_terms: int) -> list[dict[str, float]]:
    """Inverse document frequencies of each fold's most frequent terms: term → idf, as NgramTfidf learns them from the rows where `training[j]` holds.

    One pass counts the terms for all folds; at most `max_terms` rows a fold reach the driver.
    """
    counted = materialize(_counted_terms(df, text, training))
    tops = [
        counted.filter(F.col("term").isNull() | (F.col("corpus_count")[j] > 0)).orderBy(F.col("term").isNotNull(), F.col("corpus_count")[j].desc(), "term")
        .limit(max_terms + 1).select(F.lit(j).alias("fold"), "term", F.col("doc_count")[j].alias("n")) for j in range(len(training))]
    found: list[dict] = [{} for _ in training]
    for r in reduce(DataFrame.union, tops).collect():
        found[r["fold"]][r["term"]] = r["n"]
    documents = [terms.pop(None, 0) for terms in found]
    return [{t: float(np.log((1 + n) / (1 + k)) + 1) for t, k in terms.items()} for n, terms in zip(documents, found)]


def _term_finder(names: list[str]):
    """A function from lists of words to the row and the place in `names` of each known word and pair of neighbors, in any order."""
    known = [(at, name.split(" ")) for at, name in enumerate(names)]
    parts = {word: at for at, word in enumerate(dict.fromkeys(w for _, term in known for w in term))}
    table, many = pa.array(list(parts), pa.string()), max(1, len(parts))
    single, pairs = np.full(many, -1), {}
    for at, term in reversed(known):
        if len(term) == 1:
            single[parts[term[0]]] = at
        elif len(term) == 2:
            pairs[parts[term[0]] * many + parts[term[1]]] = at
    # The last number stands for no pair, so that every search ends at a number.
    codes = np.array([*sorted(pairs), np.iinfo(np.int64).max])
    places = np.array([*(pairs[c] for c in codes[:-1].tolist()), -1])

    def find(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row, word, at = placed(lists, table)
        near = np.flatnonzero((np.diff(at) == 1) & (np.diff(row) == 0))
        code = word[near] * many + word[near + 1]
        found = np.searchsorted(codes, code)
        index = np.concatenate([single[word], np.where(codes[found] == code, places[found], -1)])
        kept = index >= 0
        return np.concatenate([row, row[near]])[kept], index[kept]

    return find


def term_cells(text: str, names: list[str]) -> Column:
    """The known terms of a text as sparse cells (indices, values): place in `names`, and 1 + ln count."""
    width, find = max(1, len(names)), _term_finder(names)

    @F.arrow_udf("struct<indices:array<int>,values:array<double>>")
    def cells(lists: pa.Array) -> pa.Array:
        row, index = find(lists)
        places, counts = np.unique(row * width + index, return_counts=True)
        offsets = _offsets(np.bincount(places // width, minlength=len(lists)))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array((places % width).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(1 + np.log(counts)))],
            names=["indices", "values"])

    return opaque(cells)(words(text))


class NgramTfidf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the most frequent words and word pairs and their smoothed inverse document frequencies."""

    maxTerms = Param(Params._dummy(), "maxTerms", "terms kept, by corpus count", TypeConverters.toInt)

    def __init__(self, inputCol: str = "window_text", outputCol: str = "text_vector", maxTerms: int = 1500):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, maxTerms=maxTerms)

    def _fit(self, dataset: DataFrame) -> "NgramTfidfModel":
        # One pass over the texts: the null term, sorted first, counts the documents.
        counted = _counted_terms(dataset, self.getInputCol()).orderBy(F.col("term").isNotNull(), F.col("corpus_count").desc(), "term")
        top = counted.limit(self.getOrDefault(self.maxTerms) + 1).collect()
        documents = sum(r["doc_count"] for r in top if r["term"] is None)
        rows = sorted((r for r in top if r["term"] is not None), key=lambda r: r["term"])
        idf = [float(np.log((1 + documents) / (1 + r["doc_count"])) + 1) for r in rows]
        model = NgramTfidfModel(self.getInputCol(), self.getOutputCol())
        return model._set(vocabulary=[r["term"] for r in rows], idf=idf)


class NgramTfidfModel(
    Model, HasInputCol, HasOutputCol, _HasVocabulary, DefaultParamsReadable, DefaultParamsWritable
):
    """Weights (1 + ln count) · idf, scaled to length 1."""

    idf = Param(Params._dummy(), "idf", "inverse document frequency per term", TypeConverters.toListFloat)

    def __init__(self, inputCol: str = "window_text", outputCol: str = "text_vector"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _weigher(self):
        names, find = pa.array(self.getVocabulary(), pa.string()), _term_finder(self.getVocabulary())
        idf = np.array(self.getOrDefault(self.idf))
        width = len(idf)

        def weigh(lists: pa.Array):
            row, index = find(lists)
            cells, counts = np.unique(row * width + index, return_counts=True)
            row, index = cells // width, cells % width
            weight = (1 + np.log(counts)) * idf[index]
            norm = np.sqrt(np.bincount(row, weight ** 2, minlength=len(lists)))
            return row, index, weight / norm[row]

        return names, weigh

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, weigh = self._weigher()

        @F.arrow_udf(VectorUDT())
        def to_vector(lists: pa.Array) -> pa.Array:
            return _sparse_vectors(len(lists), len(names), *weigh(lists))

        return dataset.withColumn(self.getOutputCol(), opaque(to_vector)(words(self.getInputCol())))

    def products(self, weights: np.ndarray) -> Column:
        """Each row's vector times `weights`, without a column of vectors."""
        _, weigh = self._weigher()

        @F.arrow_udf("double")
        def dot(lists: pa.Array) -> pa.Array:
            row, index, weight = weigh(lists)
            return _dot(len(lists), row, weight * weights[index])

        return opaque(dot)(words(self.getInputCol()))

    def weights(self, dataset: DataFrame, output: str = "term_weights") -> DataFrame:
        """Adds the weights as a map term → weight."""
        names, weigh = self._weigher()

        @F.arrow_udf(T.MapType(T.StringType(), T.DoubleType()))
        def to_map(lists: pa.Array) -> pa.Array:
            row, index, weight = weigh(lists)
            offsets = _offsets(np.bincount(row, minlength=len(lists)))
            return pa.MapArray.from_arrays(offsets, names.take(pa.array(index)), pa.array(weight))

        return dataset.withColumn(output, opaque(to_map)(words(self.getInputCol())))
