"""SPARQL queries over the quads table, compiled to DataFrame plans.

Every message (``model_id``) is queried alone, so each join and group has ``model_id`` in its key.
A solution table has ``model_id`` and one term column ``?name`` for each variable; an unbound
variable is null. Variables that may be unbound join by compatibility; all others by equality.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.closure import reach, subgraph
from tessera.operators.quads import COLUMNS, TERM, as_set, from_terms, held, iri, obj, statements, subject, term
from tessera.plans import sparql_expressions as X
from tessera.plans.sparql_parser import Query, SparqlError, parse, parse_path


@dataclass
class Solutions:
    df: DataFrame
    certain: frozenset[str]
    possible: frozenset[str]

    def col(self, name: str) -> Column | None:
        return F.col(f"`?{name}`") if name in self.possible else None


def _cols(names) -> list[Column]:
    return [F.col(f"`?{n}`") for n in sorted(names)]


class Compiler:
    def __init__(self, quads: DataFrame, services: Mapping[str, DataFrame] | None = None, graph: tuple | None = None):
        self.quads, self.services, self.graph = quads, services or {}, graph
        self.models = quads.select("model_id").distinct()

    def scoped(self, graph: tuple | None) -> Compiler:
        return Compiler(self.quads, self.services, graph)

    def unit(self) -> Solutions:
        return Solutions(self.models, frozenset(), frozenset())

    # triples and paths

    def source(self) -> DataFrame:
        if self.graph is None:
            return self.quads.where(F.col("g").isNull())
        if self.graph[0] == "iri":
            return self.quads.where(F.col("g") == self.graph[1])
        return self.quads.where(F.col("g").isNotNull())

    def bound(self, df: DataFrame, ends: list[tuple[tuple, Column]]) -> Solutions:
        """Filter by the constant ends, name the variable ones."""
        names: dict[str, Column] = {}
        for node, col in ends:
            if node[0] in ("iri", "lit"):
                df = df.where(col == X.constant(node))
                continue
            name = node[1] if node[0] == "var" else f"_:{node[1]}"
            if name in names:
                df = df.where(names[name] == col)
            names[name] = names.get(name, col)
        out = df.select("model_id", *[c.alias(f"?{n}") for n, c in names.items()])
        return Solutions(out, frozenset(names), frozenset(names))

    def triple(self, s: tuple, p: tuple, o: tuple) -> Solutions:
        if p[0] in ("iri", "var"):
            df, ends = self.source(), []
            for node, value, kind in ((s, "s", "s_kind"), (o, "o", "o_kind")):
                if node[0] == "iri":  # plain comparisons reach the scan
                    df = df.where((F.col(value) == node[1]) & (F.col(kind) == "iri"))
                elif node[0] == "lit":
                    df = df.where((F.col(value) == node[1]) & (F.col(kind) == "literal"))
                    df = df.where(F.coalesce("o_dt", F.lit(X.XSD + "string")) == node[2]).where(F.col("o_lang").eqNullSafe(F.lit(node[3])))
                else:
                    ends.append((node, subject() if value == "s" else obj()))
            if p[0] == "iri":
                df = df.where(F.col("p") == p[1])
            else:
                ends.append((p, iri(F.col("p"))))
            if self.graph is not None and self.graph[0] == "var":
                ends.append((self.graph, iri(F.col("g"))))
            return self.bound(df, ends)
        if self.graph is not None and self.graph[0] == "var":
            raise SparqlError("property paths inside GRAPH ?variable are not supported")
        if p[0] in ("star", "plus") and s[0] not in ("iri", "lit") and o[0] in ("iri", "lit"):  # walk from the known end
            return self.bound(self.path((p[0], ("inv", p[1])), X.constant(o)), [(o, F.col("a")), (s, F.col("b"))])
        start = X.constant(s) if s[0] in ("iri", "lit") else None
        return self.bound(self.path(p, start), [(s, F.col("a")), (o, F.col("b"))])

    def stars(self, triples: list) -> list[list]:
        """Triples in groups of one subject variable and fixed predicates; other triples stand alone."""
        out: dict = {}
        for n, (s, p, o) in enumerate(triples):
            fixed = s[0] in ("var", "bnode") and p[0] == "iri" and o != s and (self.graph is None or self.graph[0] == "iri")
            taken = o[0] in ("var", "bnode") and any(o == other for _, _, other in out.get(s, []))
            key = s if fixed and not taken else n
            out.setdefault(key, []).append((s, p, o))
        return list(out.values())

    def star(self, triples: list) -> Solutions:
        """Several patterns on one subject: one scan and one grouping by subject in place of joins.

        A model is a set, so the objects of a predicate can be gathered as sets; their product is
        what joining the patterns gives. One subject's statements are gathered: models are messages, of bounded size.
        """
        s = triples[0][0]
        wanted, sets = F.lit(False), []
        for i, (_, p, o) in enumerate(triples):
            match = F.col("p") == p[1]
            if o[0] in ("iri", "lit"):
                match = match & (F.col("o") == o[1]) & (obj() == X.constant(o))
            wanted = wanted | match
            sets.append(F.collect_set(F.when(match, obj())).alias(f"_o{i}"))
        df = self.source().where(F.col("p").isin(*{p[1] for _, p, _ in triples})).where(wanted)
        df = df.groupBy("model_id", "s", "s_kind").agg(*sets)
        for i in range(len(triples)):
            df = df.where(F.size(f"_o{i}") > 0)
        name = lambda node: node[1] if node[0] == "var" else f"_:{node[1]}"
        out, names = df.withColumn(f"?{name(s)}", subject()), [name(s)]
        for i, (_, _, o) in enumerate(triples):
            if o[0] in ("var", "bnode"):
                out = out.withColumn(f"?{name(o)}", F.explode(f"_o{i}"))
                names.append(name(o))
        return Solutions(out.select("model_id", *[F.col(f"`?{n}`") for n in names]), frozenset(names), frozenset(names))

    def closure(self, s: tuple, p: tuple, o: tuple, known: Solutions | None) -> Solutions:
        """A pattern of a closure, walked from the nodes that the other patterns beside it leave for one end."""
        for node, end, path, flip in ((s, o, p, False), (o, s, (p[0], ("inv", p[1])), True)):
            if known is not None and node[0] == "var" and node[1] in known.certain and self.graph is None:
                starts = known.df.select("model_id", known.col(node[1]).alias("start")).distinct()
                found = self.path(path, starts=starts)
                return self.bound(found, [(end, F.col("b")), (node, F.col("a"))] if flip else [(node, F.col("a")), (end, F.col("b"))])
        return self.triple(s, p, o)

    def path(self, p: tuple, start: Column | None = None, starts: DataFrame | None = None) -> DataFrame:
        """(model_id, a, b): the pairs of a path; a closure is walked from ``start`` or ``starts`` (model_id, start) alone, if given."""
        tag = p[0]
        if tag == "iri":
            return self.source().where(F.col("p") == p[1]).select("model_id", subject().alias("a"), obj().alias("b"))
        if tag == "inv":
            return self.path(p[1]).select("model_id", F.col("b").alias("a"), F.col("a").alias("b"))
        if tag == "seq":
            left = self.path(p[1][0])
            for step in p[1][1:]:
                right = self.path(step).select("model_id", F.col("a").alias("m"), F.col("b").alias("c"))
                left = left.withColumnRenamed("b", "m").join(right, ["model_id", "m"]).select("model_id", "a", F.col("c").alias("b"))
            return left
        if tag == "alt":
            out = self.path(p[1][0])
            for other in p[1][1:]:
                out = out.unionByName(self.path(other))
            return out
        if tag == "neg":
            parts = []
            if p[1] or not p[2]:
                parts.append(self.source().where(~F.col("p").isin(*p[1])).select("model_id", subject().alias("a"), obj().alias("b")))
            if p[2]:
                parts.append(self.source().where(~F.col("p").isin(*p[2])).select("model_id", obj().alias("a"), subject().alias("b")))
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        pairs = self.path(p[1])
        edges = pairs.select("model_id", F.col("a").alias("src"), F.col("b").alias("dst"))
        src = self.source()
        if start is not None:  # a given end matches itself, in the graph or not
            nodes, pairs = self.models.select("model_id", start.alias("start")), pairs.where(F.col("a") == start)
        elif starts is not None:
            nodes, pairs = starts, pairs.join(starts.withColumnRenamed("start", "a"), ["model_id", "a"], "left_semi")
        else:
            nodes = src.select("model_id", subject().alias("start")).unionByName(src.select("model_id", obj().alias("start"))).distinct()
        itself = nodes.select("model_id", F.col("start").alias("a"), F.col("start").alias("b"))
        if tag == "opt":
            return pairs.unionByName(itself).distinct()
        if tag == "star":
            return reach(edges, nodes).select("model_id", F.col("start").alias("a"), F.col("node").alias("b"))
        leaving = pairs.select("model_id", F.col("a").alias("src"), F.col("b").alias("start"))
        ends = reach(edges, leaving.select("model_id", "start").distinct())
        first = leaving.join(ends.select("model_id", "start", "node"), ["model_id", "start"])
        return first.select("model_id", F.col("src").alias("a"), F.col("node").alias("b")).distinct()

    # joins

    def join(self, a: Solutions, b: Solutions, how: str = "inner", condition=None) -> Solutions:
        """``condition``: from the joined solutions to a boolean column, for the filters of an OPTIONAL."""
        shared = a.possible & b.possible
        right = b.df.select(F.col("model_id").alias("_m"), *[F.col(f"`?{n}`").alias(f"_r?{n}" if n in shared else f"?{n}") for n in sorted(b.possible)])
        on = F.col("model_id") == F.col("_m")
        for n in sorted(shared):
            x, y = F.col(f"`?{n}`"), F.col(f"`_r?{n}`")
            on = on & ((x == y) if n in a.certain & b.certain else (x.isNull() | y.isNull() | (x == y)))
        if condition is not None:
            merged = lambda n: F.coalesce(F.col(f"`?{n}`"), F.col(f"`_r?{n}`")) if n in shared else (F.col(f"`?{n}`") if n in a.possible | b.possible else None)
            on = on & condition(merged)
        joined = a.df.join(right, on, how)
        keep = [F.coalesce(F.col(f"`?{n}`"), F.col(f"`_r?{n}`")).alias(f"?{n}") if n in shared and n not in a.certain else F.col(f"`?{n}`") for n in sorted(a.possible | b.possible)]
        certain = a.certain | b.certain if how == "inner" else a.certain
        return Solutions(joined.select("model_id", *keep), certain, a.possible | b.possible)

    def matching(self, a: Solutions, b: Solutions, how: str, need_shared: bool) -> Solutions:
        """Semi or anti join on compatible shared variables; MINUS needs one that is bound on both sides."""
        shared = sorted(a.possible & b.possible)
        if need_shared and not shared:
            return a
        right = b.df.select(F.col("model_id").alias("_m"), *[F.col(f"`?{n}`").alias(f"_r?{n}") for n in shared])
        on, both = F.col("model_id") == F.col("_m"), F.lit(False)
        sure = False
        for n in shared:
            x, y = F.col(f"`?{n}`"), F.col(f"`_r?{n}`")
            if n in a.certain & b.certain:
                on, sure = on & (x == y), True
            else:
                on = on & (x.isNull() | y.isNull() | (x == y))
                both = both | (x.isNotNull() & y.isNotNull())
        if need_shared and not sure:
            on = on & both
        return replace(a, df=a.df.join(right, on, how))

    # groups

    def group(self, elements: list, seed: Solutions | None = None) -> Solutions:
        now, filters = seed or None, []
        add = lambda x: x if now is None else self.join(now, x)
        for e in elements:
            tag = e[0]
            if tag == "bgp":
                parts, inner = self.stars(e[1]), None
                for part in sorted(parts, key=lambda x: x[0][1][0] in ("star", "plus")):  # closures last, as they can begin at what the others find
                    if part[0][1][0] in ("star", "plus"):
                        found = self.closure(*part[0], inner)
                    else:
                        found = self.star(part) if len(part) > 1 else self.triple(*part[0])
                    inner = found if inner is None else self.join(inner, found)
                now = add(inner) if inner is not None else now
            elif tag == "group":
                now = add(self.group(e[1]))
            elif tag == "union":
                now = add(self.union([self.group(b) for b in e[1]]))
            elif tag == "optional":
                inner = [x for x in e[1] if x[0] != "filter"]
                conditions = [x[1] for x in e[1] if x[0] == "filter"]
                plain = [c for c in conditions if not _has_exists(c)]
                right = self.group(inner + [("filter", c) for c in conditions if _has_exists(c)])

                def both(variables, plain=plain):
                    out = F.lit(True)
                    for c in plain:
                        out = out & F.coalesce(X.evaluate(c, variables).truth(), F.lit(False))
                    return out

                now = self.join(now or self.unit(), right, "left", both if plain else None)
            elif tag == "filter":
                filters.append(e[1])
            elif tag == "bind":
                now = now or self.unit()
                value = X.evaluate(e[1], now.col).term()
                now = Solutions(now.df.withColumn(f"?{e[2]}", value), now.certain, now.possible | {e[2]})
            elif tag == "values":
                now = add(self.values(e[1], e[2]))
            elif tag == "minus":
                now = self.matching(now or self.unit(), self.group(e[1]), "left_anti", True)
            elif tag == "graph":
                now = add(self.scoped(e[1]).group(e[2]))
            elif tag == "service":
                now = self.service(now, e)
            elif tag == "subselect":
                now = add(self.select(e[1]))
            else:
                raise SparqlError(f"unknown pattern {tag}")
        now = now or self.unit()
        for f in filters:
            now = self.filter(now, f)
        return now

    def filter(self, now: Solutions, node: tuple) -> Solutions:
        if node[0] == "exists":
            return self.matching(now, self.group(node[1]), "left_anti" if node[2] else "left_semi", False)
        if node[0] == "op" and node[1] == "and":
            return self.filter(self.filter(now, node[2]), node[3])
        if node[0] == "op" and node[1] == "not" and node[2][0] == "exists":
            return self.filter(now, ("exists", node[2][1], not node[2][2]))
        if _has_exists(node):
            raise SparqlError("EXISTS is supported as a condition of its own or in a conjunction")
        return replace(now, df=now.df.where(X.evaluate(node, now.col).truth()))

    def union(self, parts: list[Solutions]) -> Solutions:
        possible = frozenset().union(*[p.possible for p in parts])
        certain = frozenset.intersection(*[p.certain for p in parts])
        frames = [p.df.select("model_id", *[F.col(f"`?{n}`") if n in p.possible else F.lit(None).cast(TERM).alias(f"?{n}") for n in sorted(possible)]) for p in parts]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return Solutions(out, certain, possible)

    def values(self, names: list[str], rows: list[list]) -> Solutions:
        nothing = F.lit(None).cast(TERM)
        made = [F.struct(*[(X.constant(t) if t is not None else nothing).alias(n) for n, t in zip(names, row, strict=True)]) for row in rows]
        certain = frozenset(n for i, n in enumerate(names) if all(r[i] is not None for r in rows))
        if not made:
            empty = self.models.where(F.lit(False)).select("model_id", *[nothing.alias(f"?{n}") for n in names])
            return Solutions(empty, certain, frozenset(names))
        inline = self.models.select("model_id", F.explode(F.array(*made)).alias("_v"))
        return Solutions(inline.select("model_id", *[F.col(f"_v.{n}").alias(f"?{n}") for n in names]), certain, frozenset(names))

    def service(self, now: Solutions | None, e: tuple) -> Solutions:
        """A registered table of quads stands for the remote endpoint; it is the same for every model
        and joins on the variables it shares with what stands before it."""
        name = e[1][1]
        if name not in self.services:
            if e[3]:
                return now or self.unit()
            raise SparqlError(f"no table is registered for service {name}")
        found = Compiler(self.services[name].withColumn("model_id", F.lit("")), self.services).group(e[2])
        shared = sorted(now.possible & found.possible) if now else []
        if not shared or not set(shared) <= now.certain & found.certain:
            raise SparqlError("SERVICE needs a variable that is bound before it")
        joined = now.df.join(found.df.drop("model_id"), [f"?{n}" for n in shared])
        return Solutions(joined, now.certain | found.certain, now.possible | found.possible)

    # query forms

    def select(self, q: Query) -> Solutions:
        now = self.group(q.where)
        if q.values:
            now = self.join(now, self.values(*q.values))
        names = [n for _, n in q.items]
        aggregates: list[tuple] = []

        def lifted(node):
            """Replace aggregates by variables that stand for them."""
            if not isinstance(node, tuple):
                return [lifted(x) for x in node] if isinstance(node, list) else node
            if node and node[0] == "agg":
                if node not in aggregates:
                    aggregates.append(node)
                return ("var", f"_agg{aggregates.index(node)}")
            return tuple(lifted(x) for x in node)

        items = [(lifted(e), n) for e, n in q.items]
        having, order = [lifted(e) for e in q.having], [(lifted(e), d) for e, d in q.order]
        if q.group or aggregates:
            now = self.grouped(now, q.group, aggregates)
        for h in having:
            now = self.filter(now, h)
        if not items:
            names = sorted(n for n in now.possible if not n.startswith("_:"))
            items = [(("var", n), n) for n in names]
        df = now.df
        for e, n in items:
            if e != ("var", n):
                df = df.withColumn(f"?{n}", X.evaluate(e, Solutions(df, now.certain, now.possible).col).term())
                now = Solutions(df, now.certain, now.possible | {n})
        absent = [n for n in names if n not in now.possible]
        for n in absent:
            df = df.withColumn(f"?{n}", F.lit(None).cast(TERM))
        now = Solutions(df, now.certain, now.possible | set(absent))
        keys = self.sort_keys(now, order)
        if q.distinct:
            if not set(_variables(order)) <= set(names) and order:
                raise SparqlError("ORDER BY of a DISTINCT query must use selected variables")
            df = df.select("model_id", *[F.col(f"`?{n}`") for n in names]).distinct()
        if q.limit is not None or q.offset:
            rank = F.row_number().over(W.partitionBy("model_id").orderBy(*(keys or _cols(names) or [F.lit(0)])))
            last = q.offset + q.limit if q.limit is not None else None
            df = df.withColumn("_rank", rank).where(F.col("_rank") > q.offset)
            df = df.where(F.col("_rank") <= last) if last is not None else df
            df = df.orderBy("model_id", "_rank") if keys else df
        elif keys:
            df = df.orderBy("model_id", *keys)
        return Solutions(df.select("model_id", *[F.col(f"`?{n}`") for n in names]), now.certain & set(names), frozenset(names))

    def sort_keys(self, now: Solutions, order: list) -> list[Column]:
        keys = []
        for e, down in order:
            v = X.evaluate(e, now.col)
            for k in (v.number(), v.text()) if v.kind == "term" else (v.col,):
                keys.append(k.desc() if down else k.asc())
        return keys

    def grouped(self, now: Solutions, group: list, aggregates: list[tuple]) -> Solutions:
        df = now.df
        for e, n in group:
            if e != ("var", n):
                df = df.withColumn(f"?{n}", X.evaluate(e, now.col).term())
        names = [n for _, n in group]
        made = []
        for i, (_, name, e, distinct, separator) in enumerate(aggregates):
            made.append(self.aggregate(name, X.evaluate(e, now.col) if e is not None else None, distinct, separator, now).alias(f"?_agg{i}"))
        keys = [F.col(f"`?{n}`") for n in names]
        out = df.groupBy("model_id", *keys).agg(*(made or [F.count("*").alias("_n")]))
        if not group:  # a model without solutions still has one group
            zero = [F.coalesce(F.col(f"`?_agg{i}`"), X.Value("int", F.lit(0)).term()).alias(f"?_agg{i}") if a[1] in ("COUNT", "SUM") else F.col(f"`?_agg{i}`") for i, a in enumerate(aggregates)]
            out = self.models.join(out, "model_id", "left").select("model_id", *zero)
        certain = frozenset(n for n in names if n in now.certain)
        return Solutions(out, certain, frozenset(names) | {f"_agg{i}" for i in range(len(aggregates))})

    def aggregate(self, name: str, v: X.Value | None, distinct: bool, separator: str, now: Solutions) -> Column:
        if name == "COUNT":
            if v is None:
                return X.Value("int", F.count_distinct(F.struct(*_cols(now.possible))) if distinct else F.count("*")).term()
            return X.Value("int", F.count_distinct(v.col) if distinct else F.count(v.col)).term()
        if name in ("SUM", "AVG"):
            number = v.number()
            total = (F.sum_distinct(number) if distinct else F.sum(number)) if name == "SUM" else F.avg(number)
            if v.kind == "term":
                whole = F.every(v.col["dt"] == X.XSD + "integer") & F.lit(name == "SUM")
                return F.when(whole, X.Value("int", total.cast("long")).term()).otherwise(X.Value("num", total.cast("double")).term())
            return X.Value("int" if v.kind == "int" and name == "SUM" else "num", total).term()
        if name in ("MIN", "MAX"):
            pick = F.min if name == "MIN" else F.max
            if v.kind != "term":
                return X.Value(v.kind, pick(v.col)).term()
            return pick(F.struct(v.number().alias("n"), v.col["v"].alias("v"), v.col.alias("t")))["t"]
        if name == "SAMPLE":
            return F.min(v.term())
        texts = F.array_sort(F.collect_set(v.text()) if distinct else F.collect_list(v.text()))
        return X.Value("str", F.array_join(texts, separator)).term()

    def construct(self, q: Query) -> DataFrame:
        now = self.group(q.where)
        if q.limit is not None or q.offset:
            now = self.select(replace(q, form="SELECT", items=[], template=[]))
        solution = F.sha2(F.to_json(F.struct("model_id", *_cols(now.possible))), 256)

        def slot(node: tuple | None) -> Column:
            if node is None:
                return F.lit(None).cast(TERM)
            if node[0] == "var":
                col = now.col(node[1])
                return col if col is not None else F.lit(None).cast(TERM)
            if node[0] == "bnode":
                return term(F.concat(F.lit("b"), F.substring(F.sha2(F.concat_ws("|", "_solution", F.lit(node[1])), 256), 1, 32)), "bnode")
            return X.constant(node)

        rows = now.df.withColumn("_solution", solution)
        made = F.array(*[F.struct(slot(s).alias("s"), slot(p)["v"].alias("p"), slot(o).alias("o"), slot(g)["v"].alias("g"), F.lit(g is not None).alias("named")) for s, p, o, g in q.template])
        flat = rows.select("model_id", F.explode(made).alias("t")).where(~F.col("t.named") | F.col("t.g").isNotNull())
        return as_set(from_terms(flat, F.col("t.s"), F.col("t.p"), F.col("t.o"), F.col("t.g")))

    def ask(self, q: Query) -> DataFrame:
        hits = self.group(q.where).df.select("model_id").distinct().withColumn("answer", F.lit(True))
        return self.models.join(hits, "model_id", "left").select("model_id", F.coalesce("answer", F.lit(False)).alias("answer"))

    def describe(self, q: Query) -> DataFrame:
        fixed = [n[1] for n in q.items if n[0] == "iri"]
        roots = None
        if q.where:
            now = self.group(q.where)
            names = [n[1] for n in q.items if n[0] == "var"] if q.items else sorted(now.possible)
            for n in names:
                part = now.df.where(now.col(n)["k"] != "literal").select("model_id", now.col(n)["v"].alias("root"))
                roots = part if roots is None else roots.unionByName(part)
        if fixed:
            part = self.models.select("model_id", F.explode(F.array(*map(F.lit, fixed))).alias("root"))
            roots = part if roots is None else roots.unionByName(part)
        return as_set(subgraph(self.source(), roots.distinct(), F.col("o_kind") == "bnode"))


def _has_exists(node) -> bool:
    if isinstance(node, tuple):
        return bool(node) and (node[0] == "exists" or any(map(_has_exists, node)))
    return isinstance(node, list) and any(map(_has_exists, node))


def _variables(node) -> list[str]:
    if isinstance(node, tuple) and len(node) == 2 and node[0] == "var":
        return [node[1]]
    return [n for x in node for n in _variables(x)] if isinstance(node, (tuple, list)) else []


def _dataset(quads: DataFrame, q: Query) -> DataFrame:
    """FROM and FROM NAMED choose which graphs are the default and the named ones."""
    if not q.from_graphs and not q.from_named:
        return quads
    default = quads.where(F.col("g").isin(*q.from_graphs)).withColumn("g", F.lit(None).cast("string"))
    return as_set(default.unionByName(quads.where(F.col("g").isin(*q.from_named))))


def select(quads: DataFrame, text: str, services: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Solutions of a SELECT: model_id and a term column for each variable, under its plain name."""
    q = parse(text)
    if q.form != "SELECT":
        raise SparqlError("not a SELECT query")
    found = Compiler(_dataset(quads, q), services).select(q)
    names = [n for _, n in q.items] or sorted(found.possible)
    return found.df.select("model_id", *[F.col(f"`?{n}`").alias(n) for n in names])


def values(solutions: DataFrame, **types: str) -> DataFrame:
    """Lexical values in place of terms, cast where ``types`` names a Spark type."""
    cols = [c for c in solutions.columns if c != "model_id"]
    return solutions.select("model_id", *[(F.col(f"`{c}`")["v"].cast(types[c]) if c in types else F.col(f"`{c}`")["v"]).alias(c) for c in cols])


def json_rows(solutions: DataFrame) -> DataFrame:
    """(model_id, json): each model's solutions as a JSON array; unbound variables are left out,
    integers, doubles and booleans are typed."""
    cols = [c for c in solutions.columns if c != "model_id"]

    def value(c: str) -> Column:
        t = F.col(f"`{c}`")
        number = F.when(t["dt"].isin(X.XSD + "integer", X.XSD + "int", X.XSD + "long"), t["v"].try_cast("long").cast("string")).when(t["dt"].isin(X.XSD + "double", X.XSD + "decimal", X.XSD + "float"), t["v"].try_cast("double").cast("string")).when(t["dt"] == X.XSD + "boolean", t["v"])
        text = F.regexp_extract(F.to_json(F.struct(t["v"].alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        return F.when(t.isNotNull(), F.concat(F.lit(f'"{c}":'), F.coalesce(number, text)))

    rows = solutions.select("model_id", F.concat(F.lit("{"), F.array_join(F.array(*map(value, cols)), ","), F.lit("}")).alias("r"))
    return rows.groupBy("model_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("r")), ","), F.lit("]")).alias("json"))


def ask(quads: DataFrame, text: str, services: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(model_id, answer) for every model."""
    q = parse(text)
    return Compiler(_dataset(quads, q), services).ask(q)


def route(quads: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The quads of the models for which an ASK is true, and those for which it is false; models held as rows stay rows.

    What has no hit is false, so nothing but the hits is looked up.
    """
    q = parse(text)
    hits = Compiler(_dataset(statements(quads), q)).group(q.where).df.select("model_id").distinct()
    named = quads.where(F.col("model_id").isNotNull())
    columns = quads.columns if held(quads) else COLUMNS
    return named.join(hits, "model_id", "left_semi").select(*columns), named.join(hits, "model_id", "left_anti").select(*columns)


def construct(quads: DataFrame, text: str, infer: bool = False, split_graphs: bool = True, services: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Quads that a CONSTRUCT (or DESCRIBE) gives for each model.

    If a model's result has named graphs, each graph becomes a model of its own, ``model_id``
    followed by ``#`` and the graph, united with the result's default graph. ``infer`` adds the
    input to the result, where that is a single model.
    """
    q = parse(text)
    compiler = Compiler(_dataset(quads, q), services)
    made = compiler.describe(q) if q.form == "DESCRIBE" else compiler.construct(q)
    if split_graphs and any(g is not None for *_, g in q.template):  # else all of it is in the default graph
        made = graphs_to_models(made)
    if infer:
        several = made.where(F.contains("model_id", F.lit("#graph="))).select(F.substring_index("model_id", "#graph=", 1).alias("model_id"))
        extra = quads.join(several.distinct(), "model_id", "left_anti")
        made = as_set(made.unionByName(extra.select(*COLUMNS)))
    return made


def graphs_to_models(quads: DataFrame) -> DataFrame:
    """One model for each named graph, with the statements of the default graph in each; models without named graphs stay."""
    graphs = quads.where(F.col("g").isNotNull()).select("model_id", F.col("g").alias("_g")).distinct()
    joined = quads.join(graphs, "model_id", "left").where(F.col("_g").isNull() | F.col("g").isNull() | (F.col("g") == F.col("_g")))
    split = F.when(F.col("_g").isNotNull(), F.concat("model_id", F.lit("#graph="), "_g")).otherwise(F.col("model_id"))
    count = graphs.groupBy("model_id").agg(F.count("*").alias("_n"))
    named = joined.join(count, "model_id", "left").withColumn("model_id", F.when(F.col("_n") == 1, F.col("model_id")).otherwise(split))
    return as_set(named.withColumn("g", F.lit(None).cast("string")))


def property_path(quads: DataFrame, path: str) -> DataFrame:
    """(model_id, subject, object): the pairs of a property path in each model's default graph."""
    return Compiler(quads).path(parse_path(path)).select("model_id", F.col("a").alias("subject"), F.col("b").alias("object"))
