"""The quads table: one row a statement, grouped into models by ``model_id``.

A model is a set of statements; every operator keeps models apart by having ``model_id`` in each
of its keys. ``g`` is null for the default graph; ``o_dt`` and ``o_lang`` are set for literals only.

Models of bounded size may also be held as rows, (model_id, statements): an array of statements
without repeats, ``model_id`` in one row only. What is done within a model then needs no exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.vocabulary import RDF_TYPE, XSD_STRING

COLUMNS = ("model_id", "g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
#: Bytes of a table's files for each partition of the models that are made of it.
PARTITION_BYTES = 1 << 19
#: The type of a term column: value, kind ('iri', 'bnode', 'literal'), datatype, language.
TERM = T.StructType([T.StructField(c, T.StringType()) for c in ("v", "k", "dt", "lang")])


def term(v: Column, k: Column | str, dt: Column | str | None = None, lang: Column | str | None = None) -> Column:
    """A term; null where ``v`` is null."""
    as_column = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    made = F.struct(v.cast("string").alias("v"), as_column(k).alias("k"), as_column(dt).alias("dt"), as_column(lang).alias("lang"))
    return F.when(v.isNotNull(), made)


def iri(v: Column) -> Column:
    return term(v, "iri")


def literal(v: Column, dt: Column | str = XSD_STRING, lang: Column | str | None = None) -> Column:
    return term(v, "literal", dt, lang)


def when_literal(condition: Column, v: Column, dt: str = XSD_STRING) -> Column:
    """A literal where the condition holds, else null."""
    return literal(F.when(condition, v), dt)


def subject() -> Column:
    return term(F.col("s"), F.col("s_kind"))


def obj() -> Column:
    return term(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))


def from_terms(df: DataFrame, s: Column, p: Column, o: Column, g: Column | None = None) -> DataFrame:
    """Quads from a subject term, a predicate IRI, an object term and a graph IRI; rows that lack one go."""
    rows = df.select("model_id", (g if g is not None else F.lit(None)).cast("string").alias("g"), s.alias("_s"), p.alias("p"), o.alias("_o"))
    rows = rows.where(F.col("_s").isNotNull() & F.col("p").isNotNull() & F.col("_o").isNotNull() & (F.col("_s.k") != "literal"))
    return rows.select("model_id", "g", F.col("_s.v").alias("s"), F.col("_s.k").alias("s_kind"), "p", F.col("_o.v").alias("o"), F.col("_o.k").alias("o_kind"), F.col("_o.dt").alias("o_dt"), F.col("_o.lang").alias("o_lang"))


def as_set(quads: DataFrame) -> DataFrame:
    """Models are sets: repeated statements go."""
    return quads.select(*COLUMNS).dropDuplicates()


def held(df: DataFrame) -> bool:
    """Are the models held as rows?"""
    return "statements" in df.columns


def statements(df: DataFrame) -> DataFrame:
    """Quads of models held as rows; quads stay as they are."""
    return df.select("model_id", F.inline("statements")).select(*COLUMNS) if held(df) else df


def distinct_statements(array: Column) -> Column:
    """An array of statements, sorted, without repeats; ``array_distinct`` would compare each with each."""
    others = lambda found: F.filter(found, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(found, i - 1)))
    return F.get(F.transform(F.array(F.sort_array(array)), others), F.lit(0))


def once(models: DataFrame, array: Column) -> DataFrame:
    """Models held as rows with other statements. Exploding an array of one keeps what stands above from repeating the work."""
    return models.select("model_id", F.explode(F.array(array)).alias("statements"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out


def lift(df: DataFrame, model_id: Column, subject_iri: Column, properties: Mapping[str, Column], rdf_type: str | None = None) -> DataFrame:
    """Quads of a table, one subject a row. ``properties`` maps predicate IRIs to term columns; null terms are left out.

    The statements of a row come out of one array, so the table is scanned once and never joined.
    """
    pairs = [F.struct(F.lit(p).alias("p"), t.alias("o")) for p, t in properties.items()]
    if rdf_type is not None:
        pairs.insert(0, F.struct(F.lit(RDF_TYPE).alias("p"), iri(F.lit(rdf_type)).alias("o")))
    rows = df.select(model_id.cast("string").alias("model_id"), subject_iri.alias("_s"), F.explode(F.array(*pairs)).alias("_t"))
    return from_terms(rows, iri(F.col("_s")), F.col("_t.p"), F.col("_t.o"))


def partitions(table: DataFrame) -> int:
    """How many partitions hold the models made of a table's rows: their number follows the bytes of its files.

    Adaptive execution would go by bytes of compressed rows, and put ever more models into a task.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(table.sparkSession.sparkContext.defaultParallelism, min(-(-size // PARTITION_BYTES), 20_000))


def lift_models(rows: DataFrame, model_id: Column, subjects: Callable[[Callable[[str], Column]], Sequence[tuple]], parts: int) -> DataFrame:
    """Models of a table held as rows. ``subjects`` gets what gives a column by name, and gives
    (subject IRI, properties, type) as ``lift`` takes them.

    Rows travel to their model as they are, and statements are made there. Rows of one model are united.
    """

    def pairs(col: Callable[[str], Column]) -> Column:
        out = []
        for s, properties, rdf_type in subjects(col):
            typed = {} if rdf_type is None else {RDF_TYPE: iri(F.lit(rdf_type))}
            out += [F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in [*typed.items(), *properties.items()]]
        return F.array(*out)

    def stated(found: Column) -> Column:
        whole = F.filter(found, lambda x: x["s"].isNotNull() & x["o"].isNotNull())
        return F.transform(whole, lambda x: F.struct(F.lit(None).cast("string").alias("g"), x["s"].alias("s"), F.lit("iri").alias("s_kind"), x["p"].alias("p"), x["o"]["v"].alias("o"), x["o"]["k"].alias("o_kind"), x["o"]["dt"].alias("o_dt"), x["o"]["lang"].alias("o_lang")))

    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    grouped = rows.select(model_id.cast("string").alias("model_id"), own.alias("_r")).repartition(parts, "model_id").groupBy("model_id").agg(F.collect_list("_r").alias("_rows"))
    # the first row's statements by themselves, as what stands in a lambda or beside one isn't compiled
    first = grouped.select("model_id", "_rows", F.explode(F.array(pairs(lambda c: F.col("_rows")[0][c]))).alias("_first"))
    every = F.flatten(F.transform("_rows", lambda r: pairs(lambda c: r[c])))
    return once(first, F.when(F.size("_rows") == 1, stated(F.col("_first"))).otherwise(distinct_statements(stated(every))))


def _escaped(v: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        v = F.replace(v, F.lit(plain), F.lit(code))
    return v


def nquads_term(t: Column | Mapping[str, Column]) -> Column:
    text = F.concat(F.lit('"'), _escaped(t["v"]), F.lit('"'))
    tagged = F.when(t["lang"].isNotNull(), F.concat(text, F.lit("@"), t["lang"])).when(
        t["dt"].isNotNull() & (t["dt"] != XSD_STRING), F.concat(text, F.lit("^^<"), t["dt"], F.lit(">"))
    )
    return F.when(t["k"] == "iri", F.concat(F.lit("<"), t["v"], F.lit(">"))).when(t["k"] == "bnode", F.concat(F.lit("_:"), t["v"])).otherwise(F.coalesce(tagged, text))


def nquads_line(col: Callable[[str], Column] = F.col) -> Column:
    """One line of N-Quads for each row, or for what ``col`` gives the parts of."""
    g, s = col("g"), {"v": col("s"), "k": col("s_kind"), "dt": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}
    o = {"v": col("o"), "k": col("o_kind"), "dt": col("o_dt"), "lang": col("o_lang")}
    graph = F.when(g.isNotNull(), F.concat(F.lit(" <"), g, F.lit(">"))).otherwise("")
    return F.concat(nquads_term(s), F.lit(" <"), col("p"), F.lit("> "), nquads_term(o), graph, F.lit(" ."))
