"""The surviving record of a duplicate group, field by field.

Currency reasoning: which of two rows is newer is known from their dates where those are known. Where a timestamp is
missing, precedence learned from timestamped rows helps: in groups with dated values, the style of a value (copy suffix,
case, underscores, inverted or initialled names) is followed by another style in time, and the net counts of such
transitions give a partial order of styles. A group's partial order takes both kinds of edges; styles that no chain of
transitions connects stay incomparable. Of the topologically latest values, those that no other is newer than, the
stated order picks the survivor. Where the stated order says all, no precedence is learned, and it is a chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for a missing title or author, lower case, letters only.
MISSING = (
    "unknown", "unknown author", "unknown title", "none", "null", "nil", "nan", "na", "n a", "undefined", "untitled", "untitled document", "no title", "no author",
    "title", "author", "tbd", "anonymous", "anon", "not available", "missing", "unnamed",
    "unbekannt", "unbekannter autor", "unbekannter titel", "ohne titel", "kein titel", "kein autor", "anonym", "unbenannt", "namenlos",
    "inconnu", "auteur inconnu", "titre inconnu", "sans titre", "sans nom", "anonyme", "aucun", "sans auteur",
    "desconocido", "autor desconocido", "título desconocido", "sin título", "sin titulo", "sin autor", "anónimo", "anonimo", "ninguno",
    "sconosciuto", "autore sconosciuto", "senza titolo", "desconhecido", "sem título", "sem titulo", "autor desconhecido", "onbekend",
    "неизвестно", "неизвестен", "неизвестный", "неизвестный автор", "автор неизвестен", "без названия", "без автора", "без имени", "аноним", "нет",
    "未知", "未知作者", "无标题", "無標題", "未命名", "无题", "無題", "佚名", "匿名", "不详", "作者不详", "无", "無", "不明", "作者不明", "名称未設定", "タイトルなし", "著者不明",
    "제목 없음", "제목없음", "알 수 없음", "미상", "작자 미상", "무제",
)


def is_real(value: Column) -> Column:
    """Whether a value says something: not null, not blank, and no word for a missing one in any language."""
    letters = F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.coalesce((letters != "") & ~letters.isin(*MISSING), F.lit(False))


def style(value: Column) -> Column:
    """One of few styles of a value, as a short string of flags."""
    flag = lambda pattern, name: F.when(value.rlike(pattern), name).otherwise("")
    return F.concat_ws(
        "",
        flag(r"(?i)(copy|副本|备份|_final|- old|\(\d+\)|（\d+）)\s*$", "c"),
        flag(r"_", "u"),
        flag(r"^[^,]+,\s*[^,]+$", "i"),
        flag(r"^\p{Lu}\.", "n"),
        F.when((F.lower(value) == value) & (F.upper(value) != value), "l").when((F.upper(value) == value) & (F.lower(value) != value), "U").otherwise(""),
    )


def learned_precedence(members: DataFrame, group: Sequence[str], value: str, when: str) -> set[tuple[str, str]]:
    """Pairs (earlier, later) of styles: a strict partial order learned from dated values.

    In each group a style counts from its first date on; one style follows another if it starts later. A pair is an edge if
    it occurs in more groups than the reverse, and precedence is what chains of edges connect, except where chains run
    both ways: styles on a cycle are incomparable with each other. Styles are few by construction, so the counts are a small
    table whatever the input, pre-aggregated to one row for each group and style before they are paired.
    """
    seen = members.where(F.col(when).isNotNull() & F.col(value).isNotNull()).groupBy(*group, style(F.col(value)).alias("style"))
    spans = seen.agg(F.min(when).alias("first"))
    # a group has one row a style here, so this pairing is bounded by the square of the number of styles
    a = spans.select(*group, F.col("style").alias("a"), F.col("first").alias("at"))
    b = spans.select(*group, F.col("style").alias("b"), F.col("first").alias("bt"))
    counts = a.join(b, list(group)).where("a <> b and at < bt").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {(r.a, r.b): r.n for r in counts}
    before = {(a, b) for (a, b), k in n.items() if k > n.get((b, a), 0)}
    styles = {s for pair in before for s in pair}
    for via in styles:
        before |= {(a, b) for a in styles if (a, via) in before for b in styles if (via, b) in before}
    return {(a, b) for a, b in before if (b, a) not in before}


def _latest(candidates: Column, before: set[tuple[str, str]]) -> Column:
    """Of ``candidates``, structs with style and dated, those that none of the others is newer than.

    Two dated values never meet here, as only a group's latest dated one is a candidate; an undated one is newer than
    another if its style is later.
    """
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(before)]).cast("array<string>")
    newer = lambda y, x: F.array_contains(pairs, F.concat(x["style"], F.lit(">"), y["style"]))
    return F.filter(candidates, lambda x: ~F.exists(candidates, lambda y: newer(y, x)))


def survivors(
    members: DataFrame, group: str, row: str, fields: dict[str, Column | None], order: Sequence[Column], *, field_order: dict[str, Sequence[Column]] | None = None,
    when: str | None = None, learned: dict[str, set[tuple[str, str]]] | None = None,
) -> DataFrame:
    """``(group, field_name, row)``: per group and field the member that survives for that field.

    ``fields`` maps a field name to its value column, or to None for the whole record. ``order`` lists rank columns, the
    first decides first, greater is better, null is unknown and last; ``field_order`` replaces it for single fields. A member
    enters a field only with a real value. Ties go to the smaller ``row``.

    ``when`` (the dating column) and ``learned`` (precedence of styles by field) make the order partial: a later date is
    newer, and where one has no date, a later style is. Candidates are the latest dated member and, of each style, the best
    undated one; the latest of them survive, and of several a dated one, then the one that ``order`` puts first.
    Without them the order is total, each field has one candidate, and its topologically latest member is the greatest.

    All fields are one aggregation with partial maxima before the shuffle: a group that holds a third of all rows costs
    no task more than its share, and a group has at most one candidate a style. Null groups or rows are left out; a group in
    which no member has a real value gives no row for that field; repeated members count once; further columns of
    ``members`` are never read.
    """
    own = members.where(F.col(group).isNotNull() & F.col(row).isNotNull())
    sums, chosen = [], {}
    for i, (name, value) in enumerate(fields.items()):
        ranks = (field_order or {}).get(name, order)
        ranked = [F.coalesce(r.cast("double"), F.lit(float("-inf"))).alias(f"r{k}") for k, r in enumerate(ranks)]
        real = F.lit(True) if value is None else is_real(value)
        before = (learned or {}).get(name) or set()
        known = sorted({s for pair in before for s in pair})
        dated = F.col(when).isNotNull() if when is not None and value is not None else F.lit(False)
        at = F.when(dated, F.col(when)) if when is not None and value is not None else F.lit(None).cast("timestamp")
        # a style without precedence is incomparable with all, whatever it is called
        styled = F.when(style(value).isin(known), style(value)).otherwise("?") if known else F.lit("?")
        entry = F.struct(dated.alias("dated"), at.alias("at"), *ranked, (-F.col(row)).alias("tie"), F.col(row).alias("x"), styled.alias("style"))
        candidates = [F.max(F.when(real, entry))] if not known else [F.max(F.when(real & dated, entry))] + [F.max(F.when(real & ~dated & (styled == s), entry)) for s in [*known, "?"]]
        sums.append(F.array_compact(F.array(*candidates)).alias(f"c{i}"))
        chosen[name] = F.array_max(_latest(F.col(f"c{i}"), before) if known else F.col(f"c{i}"))["x"]
    best = own.groupBy(group).agg(*sums)
    found = F.array(*[F.struct(F.lit(name).alias("field_name"), x.alias("x")) for name, x in chosen.items()])
    return best.select(group, F.explode(found).alias("f")).select(group, "f.field_name", F.col("f.x").alias(row)).where(F.col(row).isNotNull())
