"""Version objects and state objects."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.operators.closure import subgraph
from tessera.operators.quads import COLUMNS, SCHEMA, as_set, distinct_statements, held, once, statements
from tessera.storage import stash
from tessera.vocabulary import GENERATED_AT, RDF_TYPE, TREE, VERSION_OF, XSD_DATETIME

#: Links of one model that are looked up by expressions, each statement against each link.
FEW_LINKS = 32


def date_observed(quads: DataFrame, path: Sequence[str]) -> DataFrame:
    """(model_id, date): the least literal at the end of the property path whose datatype's IRI has 'datetime' in it."""
    ends = quads.where(F.col("p") == path[0]).select("model_id", "o", "o_kind", "o_dt")
    for step in path[1:]:
        below = quads.where(F.col("p") == step).select("model_id", F.col("s").alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("o", "o_kind", "o_dt")])
        ends = ends.join(below, (ends["o"] == F.col("_s")) & (ends["model_id"] == below["model_id"])).select(ends["model_id"], *[F.col(f"_{c}").alias(c) for c in ("o", "o_kind", "o_dt")])
    dates = ends.where((F.col("o_kind") == "literal") & F.lower("o_dt").contains("datetime"))
    return dates.groupBy("model_id").agg(F.min("o").alias("date"))


def create_version_objects(
    quads: DataFrame,
    member_types: Sequence[str],
    date_path: Sequence[str] = (),
    delimiter: str = "/",
    generated_at: str | None = GENERATED_AT,
    version_of: str | None = VERSION_OF,
    now: Column | None = None,
) -> DataFrame:
    """Turn each model's member into a version object.

    The member is the first subject, in order of IRI, with one of the types; it gets the IRI
    member + delimiter + date as subject only, and statements of its date and of what it is a
    version of. Models without a member stay as they are. ``now`` stands for a missing date.
    Models held as rows stay rows.
    """
    clock = now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if held(quads):
        return _version_rows(quads, member_types, date_path, delimiter, generated_at, version_of, clock)
    # one exchange by model serves the look-ups, the added statements and the removal of repeats
    model = W.partitionBy("model_id")
    of_type = (F.col("p") == RDF_TYPE) & F.col("o").isin(*member_types)
    marked = quads.select(*COLUMNS).withColumn("_member", F.min(F.when(of_type, F.col("s"))).over(model))
    if len(date_path) == 1:
        dated = (F.col("p") == date_path[0]) & (F.col("o_kind") == "literal") & F.lower("o_dt").contains("datetime")
        marked = marked.withColumn("date", F.min(F.when(dated, F.col("o"))).over(model))
    elif date_path:
        marked = marked.join(date_observed(quads, date_path), "model_id", "left")
    else:
        marked = marked.withColumn("date", F.lit(None).cast("string"))
    marked = marked.withColumn("date", F.coalesce("date", clock)).withColumn("_version", F.concat("_member", F.lit(delimiter), "date"))
    own = F.struct(F.lit(None).cast("string").alias("g"), *[F.col(c) for c in COLUMNS[2:]])
    moved = own.withField("g", F.col("g")).withField("s", F.when(F.col("s") == F.col("_member"), F.col("_version")).otherwise(F.col("s")))
    nothing = F.lit(None).cast("string")
    added = []
    if generated_at:
        added.append((generated_at, F.col("date"), "literal", F.lit(XSD_DATETIME)))
    if version_of:
        added.append((version_of, F.col("_member"), "iri", nothing))
    stated = [F.struct(nothing.alias("g"), F.col("_version").alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"), dt.alias("o_dt"), nothing.alias("o_lang")) for p, o, k, dt in added]
    # the statement of the member's type gives the new ones too; models are sets, so it doesn't matter how often
    here = of_type & (F.col("s") == F.col("_member"))
    rows = F.when(here, F.array(moved, *stated)).otherwise(F.array(moved))
    return as_set(marked.select("model_id", F.explode(rows).alias("_t")).select("model_id", "_t.*"))


def _version_rows(models: DataFrame, member_types: Sequence[str], date_path: Sequence[str], delimiter: str, generated_at: str | None, version_of: str | None, clock: Column) -> DataFrame:
    """``create_version_objects`` within each row."""
    least = lambda condition, part: F.array_min(F.transform(F.filter("statements", condition), lambda x: x[part]))
    dated = lambda x: (x["p"] == date_path[0]) & (x["o_kind"] == "literal") & F.lower(x["o_dt"]).contains("datetime")
    date = F.lit(None).cast("string")
    if len(date_path) == 1:
        date = least(dated, "o")
    elif date_path:
        models = models.join(date_observed(statements(models), date_path), "model_id", "left")
        date = F.col("date")
    marked = models.select("model_id", "statements", F.explode(F.array(F.struct(least(lambda x: (x["p"] == RDF_TYPE) & x["o"].isin(*member_types), "s").alias("member"), F.coalesce(date, clock).alias("date")))).alias("_m"))
    member, date = F.col("_m.member"), F.col("_m.date")
    marked = marked.select("model_id", "statements", member.alias("_member"), date.alias("_date"), F.concat(member, F.lit(delimiter), date).alias("_version"))
    nothing = F.lit(None).cast("string")
    added = []
    if generated_at:
        added.append((generated_at, F.col("_date"), "literal", F.lit(XSD_DATETIME)))
    if version_of:
        added.append((version_of, F.col("_member"), "iri", nothing))
    stated = [F.struct(nothing.alias("g"), F.col("_version").alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"), dt.alias("o_dt"), nothing.alias("o_lang")) for p, o, k, dt in added]
    moved = F.transform("statements", lambda x: F.struct(x["g"].alias("g"), F.when(x["s"] == F.col("_member"), F.col("_version")).otherwise(x["s"]).alias("s"), *[x[c].alias(c) for c in COLUMNS[3:]]))
    every = F.concat(moved, F.array(*stated)) if stated else moved
    met = F.exists("statements", lambda x: x["s"] == F.col("_version"))  # else nothing can be there twice
    return once(marked, F.when(F.col("_member").isNull(), F.col("statements")).when(met, distinct_statements(every)).otherwise(every))


def materialise_versions(quads: DataFrame, version_of: str = VERSION_OF, restrict_to_members: bool = False) -> DataFrame:
    """Replace version IRIs by the entity they are versions of, as subject and object, and drop the versionOf statements.

    A version of several entities takes the least. With ``restrict_to_members`` only the objects
    of tree:member and what hangs below them by blank nodes is kept, before replacement. Models
    held as rows stay rows, if they aren't restricted.
    """
    if held(quads):
        if not restrict_to_members:
            return _materialised_rows(quads, version_of)
        quads = statements(quads)
    quads = stash(quads.select(*COLUMNS), "versions")  # read for the links and for what they rename
    links = quads.where((F.col("p") == version_of) & (F.col("o_kind") != "literal"))
    entity = links.groupBy("model_id", F.col("s").alias("_v")).agg(F.min(F.struct("o", "o_kind")).alias("_e"))
    rest = restricted(quads) if restrict_to_members else quads
    rest = rest.where((F.col("p") != version_of) | (F.col("o_kind") == "literal"))
    as_s = entity.select("model_id", F.col("_v").alias("s"), F.col("_e").alias("_es"))
    as_o = entity.select("model_id", F.col("_v").alias("o"), F.col("_e").alias("_eo"))
    joined = rest.join(as_s, ["model_id", "s"], "left").join(as_o, ["model_id", "o"], "left")
    resource = F.col("o_kind") != "literal"
    return as_set(
        joined.withColumns(
            {
                "s": F.coalesce(F.col("_es.o"), F.col("s")),
                "s_kind": F.coalesce(F.col("_es.o_kind"), F.col("s_kind")),
                "o": F.when(resource, F.coalesce(F.col("_eo.o"), F.col("o"))).otherwise(F.col("o")),
                "o_kind": F.when(resource, F.coalesce(F.col("_eo.o_kind"), F.col("o_kind"))).otherwise(F.col("o_kind")),
            }
        )
    )


def _materialised_rows(models: DataFrame, version_of: str) -> DataFrame:
    """``materialise_versions`` within each row; what no expression can look up fast goes to Python."""
    link = lambda x: (x["p"] == version_of) & (x["o_kind"] != "literal")
    # statements are made once for both ways
    split = models.select("model_id", "statements", F.explode(F.array(F.filter("statements", link))).alias("_links"))
    few = split.where(F.size("_links") <= FEW_LINKS)
    pairs = F.sort_array(F.transform("_links", lambda x: F.struct(x["s"].alias("v"), F.struct(x["o"].alias("o"), x["o_kind"].alias("k")).alias("e"))))
    least = F.get(F.transform(F.array(pairs), lambda a: F.filter(a, lambda x, i: (i == 0) | (x["v"] != F.get(a, i - 1)["v"]))), F.lit(0))
    few = few.select("model_id", "statements", F.explode(F.array(F.map_from_entries(least))).alias("_e"))
    found = lambda v: F.try_element_at(F.col("_e"), v)

    def renamed(x: Column) -> Column:
        s, o = found(x["s"]), F.when(x["o_kind"] != "literal", found(x["o"]))
        parts = {"s": F.coalesce(s["o"], x["s"]), "s_kind": F.coalesce(s["k"], x["s_kind"]), "p": x["p"], "o": F.coalesce(o["o"], x["o"]), "o_kind": F.coalesce(o["k"], x["o_kind"])}
        return F.struct(x["g"].alias("g"), *[c.alias(n) for n, c in parts.items()], x["o_dt"].alias("o_dt"), x["o_lang"].alias("o_lang"))

    rest = F.filter("statements", lambda x: (x["p"] != version_of) | (x["o_kind"] == "literal"))
    few = once(few, F.when(F.size("_e") == 0, F.col("statements")).otherwise(distinct_statements(F.transform(rest, renamed))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                entity: dict[str, tuple] = {}
                for x in rows:
                    if x["p"] == version_of and x["o_kind"] != "literal":
                        e = (x["o"], x["o_kind"])
                        entity[x["s"]] = min(entity.get(x["s"], e), e)
                made = {}
                for x in rows:
                    if x["p"] == version_of and x["o_kind"] != "literal":
                        continue
                    s, sk = entity.get(x["s"], (x["s"], x["s_kind"]))
                    o, ok = entity.get(x["o"], (x["o"], x["o_kind"])) if x["o_kind"] != "literal" else (x["o"], x["o_kind"])
                    x |= {"s": s, "s_kind": sk, "o": o, "o_kind": ok}
                    made[tuple(x.values())] = x
                out.append(list(made.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, batch.schema.field(1).type)], names=["model_id", "statements"])

    parts = ", ".join(f"{c} string" for c in SCHEMA.names[1:])
    many = split.where(F.size("_links") > FEW_LINKS).select("model_id", "statements")
    return few.unionByName(map_batches(many, run, f"model_id string, statements array<struct<{parts}>>"))


def restricted(quads: DataFrame) -> DataFrame:
    """Statements of the members (objects of tree:member) and of the blank nodes below them."""
    roots = quads.where(F.col("p") == TREE + "member").select("model_id", F.col("o").alias("root")).distinct()
    return as_set(subgraph(quads, roots, F.col("o_kind") == "bnode"))


def exactly_once(members: DataFrame, key: str = "member_id", arrival: str = "arrival_seq") -> DataFrame:
    """The first arrival of each member."""
    first = W.partitionBy(key).orderBy(arrival)
    return members.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def latest_state(members: DataFrame, key: str = "version_of", timestamp: str = "ts", arrival: str = "arrival_seq") -> DataFrame:
    """Members newer than all earlier arrivals of the same entity: running maxima, not the last state alone."""
    before = W.partitionBy(key).orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)
    best = F.max(timestamp).over(before)
    return members.withColumn("_best", best).where(F.col("_best").isNull() | (F.col(timestamp) > F.col("_best"))).drop("_best")


def changed(members: DataFrame, key: str = "member_id", digest: str = "hash", arrival: str = "arrival_seq") -> DataFrame:
    """Members whose digest differs from that of the previous arrival of the same key; A, B, A passes three times."""
    last = F.lag(digest).over(W.partitionBy(key).orderBy(arrival))
    return members.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("_last") != F.col(digest))).drop("_last")


def member_filters(exactly_once_on: bool | None, materialisation: bool, latest_state_on: bool | None = None) -> list[str]:
    """Which filters run, in order. Exactly-once is on by default unless members are materialised;
    the latest-state filter exists only with materialisation, where it is on by default."""
    once = exactly_once_on if exactly_once_on is not None else not materialisation
    latest = materialisation and (latest_state_on if latest_state_on is not None else True)
    if once and latest:
        raise ValueError("the exactly-once filter can't be combined with the latest-state filter")
    return [n for n, on in (("exactly_once", once), ("latest_state", latest), ("materialise", materialisation)) if on]


def timestamps(quads: DataFrame, predicate: str, subject_column: Column | None = None) -> DataFrame:
    """(model_id, ts): wall-clock time of the least literal of ``predicate``, its zone stripped."""
    rows = quads.where((F.col("p") == predicate) & (F.col("o_kind") == "literal"))
    if subject_column is not None:
        rows = rows.where(F.col("s") == subject_column)
    text = F.regexp_replace(F.min("o"), r"(Z|[+-]\d\d:\d\d)$", "")
    return rows.groupBy("model_id").agg(F.try_to_timestamp(text).cast("timestamp_ntz").alias("ts"))


def skolemise(quads: DataFrame, domain: str) -> DataFrame:
    """Blank nodes become IRIs under the domain's genid path, the same node of a model the same IRI."""
    name = lambda c: F.concat(F.lit(domain.rstrip("/") + "/.well-known/genid/"), F.sha2(F.concat_ws("\u001f", "model_id", c), 256))
    for c in ("s", "o"):
        blank = F.col(f"{c}_kind") == "bnode"
        quads = quads.withColumns({c: F.when(blank, name(c)).otherwise(F.col(c)), f"{c}_kind": F.when(blank, "iri").otherwise(F.col(f"{c}_kind"))})
    return quads.select(*COLUMNS)
