"""JSON in text: extraction, repair and salvage as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyline.functions.text import present


def field(col: Column, name: str) -> Column:
    """The text of a top-level field (the ->> operator)."""
    return F.get_json_object(col, f"$.{name}")


def has_field(col: Column, name: str) -> Column:
    return F.array_contains(F.json_object_keys(col), name)


def field_or(col: Column, name: str, default: Column) -> Column:
    """The default only where the key is absent; a null value stays null."""
    return F.when(has_field(col, name), field(col, name)).otherwise(default)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _valid(text: Column) -> Column:
    """Whether a text that begins with a bracket is one JSON value and nothing more: as the only element of an array it parses, and there is no second."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.try_parse_json(text).isNotNull() & alone.isNotNull() & F.try_variant_get(alone, "$[1]", "string").isNull()


def extract_json(reply: Column) -> Column:
    """The JSON text in a model's reply: a fenced block, else from the first brace or bracket to the end."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.regexp_extract(reply, r"(?s)([\[{].*)$", 1)
    return present(F.trim(F.when(reply.rlike(r"(?s)```(?:json)?\s*.*?\s*```"), fenced).otherwise(F.rtrim(bare))))


# Characters that are dropped, commas before a closing bracket, and the order in which open brackets are closed.
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
TRAILING_COMMA = r",\s*([}\]])"
CLOSED_IN_TURN = (("[", "]"), ("{", "}"))


def repair_json(text: Column) -> Column:
    """Drops fences, control characters and trailing commas, and appends a closer for every bracket that has none."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("```"), F.lit("")), CONTROL_CHARACTERS, ""), TRAILING_COMMA, "$1")
    number = lambda c, x: F.char_length(c) - F.char_length(F.replace(c, F.lit(x), F.lit("")))
    closed = lambda out: F.concat(out, *(F.repeat(F.lit(shut), F.greatest(number(out, open_) - number(out, shut), F.lit(0))) for open_, shut in CLOSED_IN_TURN))
    return _bound(plain, closed)


def cut_json(text: Column) -> Column:
    """A repaired text up to its last closing bracket, closed once more if it is an array left open; null without a closer."""
    cut = F.regexp_extract(text, r"(?s)^(.*[}\]])", 1)
    number = lambda x: F.char_length(cut) - F.char_length(F.replace(cut, F.lit(x), F.lit("")))
    return F.when(cut != "", F.when(cut.startswith("[") & (number("[") > number("]")), F.concat(cut, F.lit("]"))).otherwise(cut))


def parse_reply(reply: Column) -> Column:
    """struct(status, json): EMPTY, NO_JSON, OK, REPAIRED, TRUNCATED (cut at the last closing bracket) or INVALID."""
    blank = reply.isNull() | ~reply.rlike(r"(?U)\S")

    def judged(found: Column, fixed: Column, cut: Column) -> Column:
        status = F.when(blank, "EMPTY").when(found.isNull(), "NO_JSON").when(_valid(found), "OK").when(_valid(fixed), "REPAIRED").when(_valid(cut), "TRUNCATED").otherwise("INVALID")
        return _bound(status, lambda s: F.struct(s.alias("status"), F.when(s == "OK", found).when(s == "REPAIRED", fixed).when(s == "TRUNCATED", cut).alias("json")))

    return _bound(extract_json(reply), lambda found: _bound(repair_json(found), lambda fixed: _bound(cut_json(fixed), lambda cut: judged(found, fixed, cut))))


def salvage_fields(reply: Column, *names: str) -> list[Column]:
    """String fields by pattern where no JSON can be parsed."""
    return [present(F.regexp_extract(reply, rf'"{n}"\s*:\s*"([^"]*)"', 1)).alias(n) for n in names]


def salvage_groups(reply: Column) -> Column:
    """array<struct(theme, ids)> of {"tema_principal": .., "ids_originais": [..]} objects; ids sorted and distinct."""
    pattern = r'(?s)"tema_principal"\s*:\s*"([^"]*)"[^{}\[\]]*"ids_originais"\s*:\s*\[([\d,\s]*)\]'
    themes, ids = F.regexp_extract_all(reply, F.lit(pattern), F.lit(1)), F.regexp_extract_all(reply, F.lit(pattern), F.lit(2))
    numbers = lambda t: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))))
    return F.transform(F.arrays_zip(themes.alias("theme"), ids.alias("ids")), lambda g: F.struct(g["theme"].alias("theme"), numbers(g["ids"]).alias("ids")))


def salvage_decisions(reply: Column) -> Column:
    """array<struct(kind, article, cluster, theme)> of attach and new-cluster decisions."""
    objects = F.regexp_extract_all(reply, F.lit(r"(\{[^{}]*\})"), F.lit(1))
    number = lambda o, n: F.regexp_extract(o, rf'"{n}"\s*:\s*(\d+)', 1).try_cast("long")
    string = lambda o, n: present(F.regexp_extract(o, rf'"{n}"\s*:\s*"([^"]*)"', 1))
    rows = F.transform(objects, lambda o: F.struct(string(o, "tipo").alias("kind"), number(o, "noticia_id").alias("article"), number(o, "cluster_id_existente").alias("cluster"), string(o, "tema_principal").alias("theme")))
    return F.filter(rows, lambda r: r["kind"].isin("anexar", "novo_cluster") & r["article"].isNotNull())


def _objects(reply: Column) -> Column:
    """The texts from each opening brace to the next closing one."""
    return F.regexp_extract_all(reply, F.lit(r"(?s)(\{.*?\})"), F.lit(1))


def _number(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf'"{name}"\s*:\s*(\d+)', 1).try_cast("long")


def salvage_merges(reply: Column) -> Column:
    """array<struct(kind, target, sources, cluster, title, tag, priority)> of merge and keep suggestions; merges without a target or sources are left out."""
    string = lambda o, n: present(F.trim(F.regexp_extract(o, rf'(?s)"{n}"\s*:\s*"(.*?)"', 1)))

    def suggestion(o: Column) -> Column:
        kind = present(F.lower(F.regexp_extract(o, r'(?i)"tipo"\s*:\s*"(merge|keep)"', 1)))
        merge = kind == "merge"
        digits = F.transform(F.split(F.regexp_extract(o, r'(?s)"fontes"\s*:\s*\[([^\]]*)\]', 1), r"[,\s]+"), lambda t: F.regexp_replace(t, "[^0-9]", "").try_cast("long"))
        priority = present(F.regexp_extract(o, r'"nova_prioridade"\s*:\s*"(P1_CRITICO|P2_ESTRATEGICO|P3_MONITORAMENTO)"', 1))
        return F.struct(
            kind.alias("kind"), F.when(merge, _number(o, "destino")).alias("target"), F.when(merge, F.filter(digits, lambda d: d.isNotNull())).alias("sources"),
            F.when(~merge, _number(o, "cluster_id")).alias("cluster"), F.when(merge, string(o, "novo_titulo")).alias("title"), F.when(merge, string(o, "nova_tag")).alias("tag"), F.when(merge, priority).alias("priority"),
        )

    whole = lambda m: (m["kind"] == "keep") | ((F.coalesce(m["target"], F.lit(0)) != 0) & (F.size(m["sources"]) > 0))
    return F.filter(F.transform(_objects(reply), suggestion), lambda m: m["kind"].isNotNull() & whole(m))


def salvage_priorities(reply: Column) -> Column:
    """array<struct(id, priority, tag)> of an executive ranking, also where the reply breaks off."""
    decision = r'"decisao_prioridade_final"\s*:\s*"(P1_CRITICO|P2_ESTRATEGICO|P3_MONITORAMENTO|IRRELEVANTE)"'
    rows = F.transform(_objects(reply), lambda o: F.struct(_number(o, "id").alias("id"), present(F.regexp_extract(o, decision, 1)).alias("priority"), present(F.regexp_extract(o, r'"tag_final"\s*:\s*"(.*?)"', 1)).alias("tag")))
    return F.filter(rows, lambda r: r["id"].isNotNull() & r["priority"].isNotNull())


def missing_placeholders(template: Column, required: list[str]) -> Column:
    used = F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))
    return F.array_except(F.array(*(F.lit(r) for r in required)).cast("array<string>"), used)
