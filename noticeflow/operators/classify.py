"""Rule classification and weighted term scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow import policy
from noticeflow.functions.text import has_any, normalised

NO_TOPIC = "Nenhuma área temática prioritária foi identificada automaticamente."
ELIGIBILITY = ("YES", "UNCERTAIN", "UNKNOWN", "NO")


def topic_matches(c: Column, terms: Sequence[tuple[str, int]], word_boundary: bool = False) -> Column:
    """Terms that a normalised text contains, as (weight, position, term), by weight; ties in list order.

    The text is tested once for each term; let it be a column that is computed already, not an expression.
    """
    if word_boundary:
        c = F.concat(F.lit(" "), F.regexp_replace(c, r"[^a-z0-9]+", " "), F.lit(" "))
    found = []
    for weight, i, term in sorted((-w, i, t) for i, (t, w) in enumerate(terms)):
        entry = F.struct(F.lit(weight).alias("w"), F.lit(i).alias("i"), F.lit(term).alias("t"))
        found.append(F.when(c.contains(f" {term} " if word_boundary else term), entry))
    return F.array_compact(F.array(*found))


def topic_score(matches: Column) -> Column:
    return F.least(F.lit(100), F.aggregate(matches, F.lit(0), lambda a, x: a - x["w"]))


def topic_reason(matches: Column, score: Column) -> Column:
    """Level and the four heaviest terms."""
    top = F.array_join(F.transform(F.slice(matches, 1, 4), lambda x: F.initcap(x["t"])), ", ")
    level = F.when(score >= 75, "Alta").when(score >= 50, "Boa").otherwise("Aderência parcial")
    return F.when(F.size(matches) == 0, NO_TOPIC).otherwise(F.concat(level, F.lit(" devido a: "), top, F.lit(".")))


def with_eligibility(rows: DataFrame, graduation: Column, masters: Column, doctorate: Column, other: Column, out: str = "formal_eligibility") -> DataFrame:
    """Rows with their formal eligibility; the texts are normalised once, in columns of their own."""
    names = ["nf_g", "nf_m", "nf_d", "nf_o"]
    texts = dict(zip(names, (normalised(x) for x in (graduation, masters, doctorate, other)), strict=True))
    return rows.withColumns(texts).withColumn(out, eligibility(*map(F.col, names))).drop(*names)


def eligibility(g: Column, m: Column, d: Column, o: Column) -> Column:
    """Formal eligibility from normalised texts on graduation, masters, doctorate and other requirements.

    The first rule that holds decides.
    """
    post = F.concat_ws(" ", m, d)
    related = g.contains("areas afins")
    #: Graduations that exclude, and words of related or compatible postgraduate areas.
    excluding = ("engenharia ambiental", "medicina", "enfermagem", "odontologia", "farmacia", "veterinaria", "direito", "arquitetura", "psicologia")
    vague = ("desenvolvimento sustentavel", "sustentabilidade", "gestao ambiental", "desenvolvimento regional", "areas correlatas", "areas afins")
    fits = has_any(post, ("ciencias ambientais", "grande area multidisciplinar", "area multidisciplinar"))
    business = g.contains("administracao")
    rules: list[tuple[Column, str]] = [
        ((g == "") & (m == "") & (d == "") & (o == ""), "UNKNOWN"),
        (has_any(g, excluding) & ~related, "NO"),
        (g.contains("administracao publica") & ~related, "UNCERTAIN"),
        (has_any(d, ("area de avaliacao interdisciplinar", "area interdisciplinar da capes")), "UNCERTAIN"),
        (has_any(d, ("doutorado em area interdisciplinar", "doutorado na area interdisciplinar")), "UNCERTAIN"),
        (d.contains("ciencias sociais aplicadas"), "UNCERTAIN"),
        (d.contains("administracao") & has_any(d, ("areas afins", "areas correlatas")), "UNCERTAIN"),
        (d.contains("administracao"), "NO"),
        (has_any(post, vague) & ~post.contains("ciencias ambientais"), "UNCERTAIN"),
        ((g != "") & ~business, "UNKNOWN"),
        # graduation alone, without any word on postgraduate areas, stays open by intent
        (business & fits, "YES"),
        ((g == "") & fits, "YES"),
    ]
    out = F.lit(None)
    for condition, verdict in reversed(rules):
        out = F.when(condition, F.lit(verdict)).otherwise(out)
    return F.coalesce(out, F.lit("UNKNOWN"))


def institution_type(name: Column, context: Column) -> Column:
    """SUPERIOR, BASICA or INDEFINIDA, by the institution's name first."""
    n, c = normalised(name), normalised(context)
    higher = has_any(n, policy.HIGHER_NAMES) | F.coalesce(name, F.lit("")).rlike(policy.ACRONYM)
    only = has_any(c, policy.HIGHER_ONLY_WORDS)
    return F.when(higher | only, "SUPERIOR").when(has_any(n, policy.BASIC_NAMES), "BASICA").otherwise("INDEFINIDA")


def geographic_priority(state: Column) -> Column:
    out = F.lit(policy.DEFAULT_PRIORITY)
    for s, p in policy.STATE_PRIORITY:
        out = F.when(F.upper(state) == s, p).otherwise(out)
    return out


def with_priority(rows: DataFrame, priorities: DataFrame, key: str, default: int = policy.DEFAULT_PRIORITY) -> DataFrame:
    """Rows with the priority that a policy table gives their key."""
    return rows.join(F.broadcast(priorities), key, "left").withColumn("priority", F.coalesce("priority", F.lit(default)))


def visual_category(verdict: Column, score: Column) -> Column:
    return (
        F.when((verdict == "YES") & (score >= policy.STRONG_YES), "🔥 Forte oportunidade")
        .when((verdict == "UNCERTAIN") & (score >= policy.STRONG_UNCERTAIN), "🔥 Forte oportunidade")
        .when((verdict == "YES") & (score >= 50), "🟢 Elegível / alta aderência")
        .when(verdict == "YES", "🟢 Elegível")
        .when(verdict == "UNCERTAIN", "🟡 Elegibilidade incerta")
        .when(verdict == "NO", "🔴 Formalmente incompatível")
        .otherwise("⚪ Informação insuficiente")
    )


_TOPIC_COLUMNS = ("title", "description", "position", "area", "subarea", "raw_text", "official_evidence_text")


def analyzed(rows: DataFrame, terms: Sequence[tuple[str, int]] = policy.TOPIC_WEIGHTS) -> DataFrame:
    """Rows with eligibility, topic score and reason, priority and category, from the columns that they have."""

    def col(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    def requirement(name: str) -> Column:
        return F.coalesce(F.nullif(col(f"{name}_requirement_raw"), F.lit("")), col(f"{name}_requirement"))

    text = normalised(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in _TOPIC_COLUMNS]))
    judged = with_eligibility(rows.withColumn("nf_text", text), requirement("graduation"), requirement("masters"), requirement("doctorate"), col("other_requirements"))
    return (
        judged.withColumn("nf_found", topic_matches(F.col("nf_text"), terms))
        .withColumn("thematic_score", topic_score(F.col("nf_found")))
        .withColumn("thematic_reason", topic_reason(F.col("nf_found"), F.col("thematic_score")))
        .withColumn("geographic_priority", geographic_priority(col("state")))
        .withColumn("visual_category", visual_category(F.col("formal_eligibility"), F.col("thematic_score")))
        .drop("nf_text", "nf_found")
    )


def pluggable(rows: DataFrame, analyzer: Callable[[DataFrame], DataFrame], promised: Sequence[str]) -> DataFrame:
    """Rows classified by an analyzer of the user's, which must yield the promised columns."""
    out = rows.transform(analyzer)
    if missing := [c for c in promised if c not in out.columns]:
        raise ValueError(f"the analyzer doesn't return {', '.join(missing)}")
    return out


def child_rollup(children: DataFrame, parent: Sequence[str], area: str = "area", order: str = "position") -> DataFrame:
    """What relevant children say of their parent: best eligibility, counts, highest score, top four areas.

    Children without a score don't count, and parents without relevant children have no row.
    """
    relevant = children.filter(F.col("thematic_score") > 0)
    rank = F.array_position(F.array(*[F.lit(e) for e in ELIGIBILITY]), F.col("formal_eligibility"))
    w = Window.partitionBy(*parent).orderBy(F.desc("thematic_score"), order, area)
    best = relevant.withColumn("nf_k", F.row_number().over(w)).filter("nf_k <= 4")  # four rows of a parent at most are brought together
    areas = F.transform(F.array_sort(F.collect_list(F.struct("nf_k", F.col(area).alias("a")))), lambda x: x["a"])
    counts = relevant.groupBy(*parent).agg(
        F.min_by("formal_eligibility", rank).alias("formal_eligibility"),
        *[F.count_if(F.col("formal_eligibility") == e).alias(f"n_{e.lower()}") for e in ELIGIBILITY],
        F.max("thematic_score").alias("thematic_score"),
    )
    return counts.join(best.groupBy(*parent).agg(F.array_join(areas, ", ").alias("areas")).hint("merge"), [*parent])
