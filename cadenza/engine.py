"""The engine: a lexicon and the searches, comparisons and scans over columns of words and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import columns
from cadenza.functions import phonemes as ph
from cadenza.functions.dialect import Spark
from cadenza.operators import prosody, rhymemap
from cadenza.plans import compare, rhymes
from cadenza.plans.views import query
from cadenza.shared import written
from cadenza.shipping import ship
from cadenza.sources import lexicon as lx


class Engine:
    """Operators over one lexicon; DataFrames in, DataFrames out, nothing runs before an action.

    ``lexicon(word, variant, pron)`` defaults to the seed. It is broadcast up to ``lx.BROADCAST_ENTRIES`` entries
    (counted once) and joined by shuffle beyond.
    """

    def __init__(self, spark: SparkSession, lexicon: DataFrame | None = None):
        self.spark = spark
        ship(spark)
        self.lexicon = lexicon if lexicon is not None else lx.load(spark)
        self._tables: dict[str, DataFrame] = {}
        self._small = self.lexicon.count() <= lx.BROADCAST_ENTRIES

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self._small else df

    @property
    def lex0(self) -> DataFrame:
        """First variants, as the side of a join."""
        return self._side(self.lexicon.where("variant = 0").select("word", "pron"))

    def with_custom_words(self, words: DataFrame) -> Engine:
        """An engine that also knows ``words(word, phonemes array)``; they become full entries after those there are."""
        new = words.select(F.upper("word").alias("word"), columns.encode_all("phonemes").alias("pron"))
        have = self.lexicon.groupBy("word").agg((F.max("variant") + 1).alias("n"))
        new = new.join(have, "word", "left").select("word", F.coalesce("n", F.lit(0)).cast("int").alias("variant"), "pron")
        return Engine(self.spark, self.lexicon.unionByName(new))

    # Words.

    def entry_count(self) -> int:
        return self.lexicon.select("word").distinct().count()

    def lookup(self, words: DataFrame, word: str = "word") -> DataFrame:
        return prosody.lookup(words, self.lexicon, self.lex0, word)

    def contains(self, words: DataFrame, word: str = "word") -> DataFrame:
        """Rows gain ``known``."""
        named = prosody.with_norm(words, word)
        keys = self._side(self.lexicon.select(F.col("word").alias("norm")).distinct().withColumn("_k", F.lit(True)))
        return named.join(keys, "norm", "left").withColumn("known", F.coalesce("_k", F.lit(False))).drop("_k", "gdrop", "norm")

    def syllable_counts(self, lines: DataFrame, keys: list[str]) -> DataFrame:
        return prosody.line_syllables(lines, keys, self.lex0)

    # Rhymes.

    def tables(self) -> dict[str, DataFrame]:
        """The lexicon's index tables, built once and cached: they are as small as the lexicon, and lost parts are computed again."""
        if not self._tables:
            keys = prosody.with_norm(self.lexicon.select("word").distinct(), "word")
            text = f"WITH lex AS (SELECT * FROM @lex@), keys AS (SELECT * FROM @keys@), {rhymes.indexes(Spark)}, {rhymes.coda_keys(Spark)} SELECT * FROM "
            for name in ("lexi", "key0", "grp", "rg", "codas", "edges"):
                self._tables[name] = query(self.spark, text + name, lex=self.lexicon, keys=keys).distinct().cache()
        return self._tables

    def _run(self, steps: list[str], select: str, **given: DataFrame) -> DataFrame:
        """``select`` over the steps, the index tables and the given ones; what it does not use is not planned."""
        vd = self.spark.createDataFrame(ph.vowel_distances(), "a string, b string, d int")
        frames = {n: self._side(t) for n, t in {"lex": self.lexicon, **self.tables()}.items()} | {"vd": F.broadcast(vd)} | given  # vd has 225 rows
        return query(self.spark, f"WITH {', '.join([*(f'{n} AS (SELECT * FROM @{n}@)' for n in frames), *steps])} {select}", **frames)

    def _variants(self, words: DataFrame, word: str, limit: int) -> DataFrame:
        """The pronunciations of the distinct query words, written: searches use them several times."""
        q = prosody.with_norm(words.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct(), "word").withColumn("k", F.lit(min(limit, rhymes.LIMIT)))
        return written(self._run([rhymes.queries(Spark)], "SELECT * FROM qv", qn=q), "query-words")

    def perfect_rhymes(self, words: DataFrame, word: str = "word") -> DataFrame:
        """word, pos, match, phonemes, syllables, rhyme_type, confidence: every perfect rhyme."""
        return self._run([rhymes.perfect(Spark)], rhymes.described(Spark, "pf", "perfect"), qv=self._variants(words, word, rhymes.LIMIT))

    def slant_rhymes(self, words: DataFrame, limit: int = 20, word: str = "word") -> DataFrame:
        return self._run([rhymes.slant(Spark)], rhymes.described(Spark, "sl", "slant"), qv=self._variants(words, word, limit))

    def near_rhymes(self, words: DataFrame, limit: int = 20, word: str = "word") -> DataFrame:
        return self._run([rhymes.near(Spark)], rhymes.described(Spark, "nr", "near"), qv=self._variants(words, word, limit))

    def rhymes(self, words: DataFrame, limit: int = 20, word: str = "word") -> DataFrame:
        """Perfect, slant and near rhymes in this order, each match once. Each kind is written before the next one counts what it took."""
        qv = self._variants(words, word, limit)
        pf = written(self._run([rhymes.perfect(Spark)], "SELECT * FROM pf", qv=qv), "perfect")
        sl = written(self._run([rhymes.TAKEN, rhymes.slant(Spark, "n1")], "SELECT * FROM sl", qv=qv, pf=pf), "slant")
        return self._run([rhymes.rest(Spark)], rhymes.described(Spark, "all_", None), qv=qv, pf=pf, sl=sl)

    def index(self, select: str) -> DataFrame:
        """A query over the index tables lexi, key0, grp, rg, codas, edges."""
        return self._run([], select)

    def keys(self) -> DataFrame:
        """word: every entry of the lexicon once."""
        return self.lexicon.select("word").distinct()

    def counts(self) -> dict[str, int]:
        """Entries, rhyme groups, distinct codas, and codas with a neighbour."""
        t = self.tables()
        one = lambda df, c: df.select(c).distinct().count()
        return {"words": self.entry_count(), "groups": one(t["rg"], "tail"), "codas": one(t["grp"], "coda"), "neighbors": one(t["edges"], "coda")}

    # Pairs.

    def compare(self, pairs: DataFrame) -> DataFrame:
        """word1, word2, similarity, rhyme_type, confidence, phonemes1, phonemes2 of distinct pairs of known words."""
        p = pairs.select("word1", "word2").distinct()
        p = prosody.with_norm(p, "word1").withColumnsRenamed({"norm": "norm1", "gdrop": "gdrop1"})
        p = prosody.with_norm(p, "word2").withColumnsRenamed({"norm": "norm2", "gdrop": "gdrop2"})
        given = {"lex": self._side(self.lexicon), "pairs": p}
        ctes = [f"{name} AS (SELECT * FROM @{name}@)" for name in given]
        return query(self.spark, f"WITH {', '.join([*ctes, compare.compared(Spark)])} SELECT * FROM cmp", **given)

    def analyze(self, pairs: DataFrame) -> DataFrame:
        """Rows with encoded pronunciations a and b gain rhyme_type and confidence."""
        return query(self.spark, f"SELECT * FROM ({compare.analyze('@pairs@')})", pairs=pairs).select(*pairs.columns, "rhyme_type", F.col("conf").alias("confidence"))

    # Lines and documents.

    def scan(self, lines: DataFrame, keys: list[str], mode: str = "spoken") -> DataFrame:
        return prosody.scanned(lines, keys, self.lex0, mode)

    def scan_records(self, lines: DataFrame, keys: list[str], mode: str = "spoken") -> DataFrame:
        return prosody.scan_records(lines, keys, self.lex0, mode)

    def compare_meter(self, pairs: DataFrame) -> DataFrame:
        return prosody.compared_meter(pairs)

    def summary(self, docs: DataFrame, key: str, mode: str = "spoken", text: str = "text") -> DataFrame:
        return prosody.document_summary(docs, key, self.lex0, mode, text)

    def rhyme_map(self, lines: DataFrame, key: str, options: rhymemap.Options = rhymemap.Options()) -> DataFrame:
        return rhymemap.patterns(lines, key, self.lex0, options)

    def highlights(self, lines: DataFrame, key: str, options: rhymemap.Options = rhymemap.Options()) -> DataFrame:
        return rhymemap.highlights(lines, key, self.lex0, options)
