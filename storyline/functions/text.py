"""Text functions as Column expressions; Java regexes carry (?U) where classes must be Unicode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyline import domain as D

_ACCENTED = "áàãâäåéèêëíìîïóòõôöúùûüçñýÿÁÀÃÂÄÅÉÈÊËÍÌÎÏÓÒÕÔÖÚÙÛÜÇÑÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"
UNACCENTED = dict(zip(_ACCENTED, _PLAIN, strict=True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def present(c: Column) -> Column:
    """Null where a value is null or empty: a falsy string."""
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def unaccent(c: Column) -> Column:
    """Latin letters without their marks (composed forms, and combining marks by themselves)."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def first_contained(table: dict[str, str], text: Column) -> Column:
    """The value of the first key, in the table's order, that the text contains; else null."""
    return F.coalesce(*(F.when(text.contains(k), F.lit(v)) for k, v in table.items()))


def title_case(c: Column) -> Column:
    """A capital after every character that is not a letter, small letters after letters."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.char_length(w)))), "")


def fix_tag(tag: Column) -> Column:
    low = F.lower(strip(tag))
    found = F.coalesce(lookup(D.TAG_KEYWORDS, low), first_contained(D.TAG_KEYWORDS, low), F.lit(D.IRRELEVANT))
    return F.when(tag.isNull() | (tag == ""), D.DEFAULT_TAG).otherwise(found)


def canonical_tag(tag: Column, international: Column) -> Column:
    """The canonical tag of a model's tag: the same but for case, else the corrected one if it is canonical, else the default."""

    def within(tags: tuple[str, ...], default: str) -> Column:
        by_case = {t.lower(): t for t in tags}
        trimmed = strip(tag)
        found = F.coalesce(F.when(trimmed.isin(*tags), trimmed), lookup(by_case, F.lower(trimmed)), lookup(by_case, F.lower(fix_tag(trimmed))), F.lit(default))
        return F.when(tag.isNull() | (trimmed == ""), default).otherwise(found)

    return F.when(international, within(D.INTERNATIONAL_TAGS, D.DEFAULT_INTERNATIONAL_TAG)).otherwise(within(D.NATIONAL_TAGS, D.DEFAULT_TAG))


def migrated_tag(tag: Column) -> Column:
    return F.coalesce(lookup(D.OLD_TAGS, tag), F.lit(D.DEFAULT_TAG))


def migrated_score(priority: Column, score: Column, reason: Column) -> tuple[Column, Column]:
    """A record's score and reason; where one is null both are filled by its priority, a score of 0 counting as absent."""
    known = priority.isin(*D.MIGRATED_SCORES)
    absent = score.isNull() | reason.isNull()
    filled = F.when(score != 0, score).otherwise(F.coalesce(lookup(D.MIGRATED_SCORES, priority), F.lit(D.MIGRATED_SCORE)))
    why = F.concat(F.lit(D.MIGRATED_REASON), F.when(known, priority).otherwise(D.MIGRATED_PRIORITY))
    return F.when(absent, filled).otherwise(score), F.when(absent, F.when(reason != "", reason).otherwise(why)).otherwise(reason)


def fix_priority(priority: Column) -> Column:
    return F.when(priority.isin(*D.PRIORITIES), priority).otherwise(D.IRRELEVANT)


def is_advertisement(title: Column, text: Column) -> Column:
    body = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    signs = reduce(lambda a, b: a + b, (body.rlike(f"(?U){p}").cast("int") for p in D.AD_SIGNS))
    words = body.rlike(r"(?U)\b(?:" + "|".join(D.AD_WORDS) + r")\b")
    return words | (any_of(body.contains(w) for w in D.RETAIL_WORDS) & (signs >= 1)) | (signs >= 2)


def is_noise(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 2000))
    return F.coalesce(any_of(head.rlike(f"(?U){p}") for p in D.NOISE_PATTERNS), F.lit(False))


def gatekeeper(text: Column) -> Column:
    """struct(is_relevant, reason)."""
    reason = F.when(is_noise(text), "noise").when(F.char_length(strip(F.coalesce(text, F.lit("")))) < 50, "too_short").otherwise("ok")
    return F.struct((reason == "ok").alias("is_relevant"), reason.alias("reason"))


def is_financial_page(text: Column) -> Column:
    head, lead = F.lower(F.substring(text, 1, 2000)), F.substring(text, 1, 3000)
    phrases = reduce(lambda a, b: a + b, (head.contains(p).cast("int") for p in D.FINANCIAL_PHRASES))
    digits, letters = F.regexp_count(lead, F.lit(r"\p{Nd}")), F.regexp_count(lead, F.lit(r"\p{L}"))
    return (phrases >= 2) | ((letters > 0) & (digits > 0.4 * letters))


def safe_file_name(name: Column) -> Column:
    return F.when(name.isNull() | (name == ""), "arquivo_sem_nome").otherwise(F.substring(F.regexp_replace(name, r"(?U)[^\w\-_.]", ""), 1, 150))


def content_hash(text: Column, url: Column) -> Column:
    return F.sha2(F.concat(text, F.coalesce(url, F.lit(""))), 256)


def record_hash(title: Column, date: Column, missing: str = "None") -> Column:
    return F.sha2(F.concat_ws("|", title, F.coalesce(date, F.lit(missing))), 256)


def strip_html(text: Column) -> Column:
    return F.when(text.isNull(), "").otherwise(collapse(F.regexp_replace(text, r"<[^>]+>", "")))


def short_title(text: Column, words: int = 10) -> Column:
    body = collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)https?://\S+", " "))
    sentence = F.regexp_extract(body, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    first = F.when(sentence != "", sentence).otherwise(body)
    tokens = F.split(first, " ")
    cut = F.when(F.size(tokens) > words, F.array_join(F.slice(tokens, 1, words), " ")).otherwise(first)
    trimmed = F.regexp_replace(cut, r"^[ \-—:;,]+|[ \-—:;,]+$", "")
    return F.coalesce(present(trimmed), F.lit("Sem título"))


def is_generic_title(title: Column) -> Column:
    low = F.lower(strip(F.coalesce(title, F.lit(""))))
    return (low == "") | any_of(low.startswith(p) for p in D.GENERIC_TITLES)


def outlet_key(name: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(unaccent(strip(F.coalesce(name, F.lit(""))))), "[^a-z0-9]+", " "))
    return F.coalesce(lookup(D.OUTLET_ALIASES, plain), plain)


def outlet_name(name: Column) -> Column:
    s = strip(F.coalesce(name, F.lit("")))
    shown = F.coalesce(lookup(D.OUTLET_NAMES, outlet_key(s)), first_contained(D.OUTLET_NAMES, F.lower(s)), F.when((F.char_length(s) < 3) | s.rlike(r"^[\p{Nd} ]*$"), "").otherwise(s))
    return F.when(s.rlike(D.OUTLET_JUNK), "").otherwise(shown)


def source_nationality(name: Column) -> Column:
    low = F.lower(strip(F.coalesce(name, F.lit(""))))
    plain = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    return F.when(any_of(low.contains(k) | plain.contains(k) for k in D.FOREIGN_OUTLETS_SHORT), "internacional").otherwise("nacional")


def source_type(name: Column, has_url: Column, file_type: Column) -> Column:
    low, pdf = F.lower(strip(name)), file_type == "pdf"
    foreign = any_of(low.contains(k) for k in D.FOREIGN_OUTLETS)
    national = any_of(low.contains(k) for k in (*D.NATIONAL_OUTLETS, ".br", "brasil", "brazil"))
    printed = F.when(pdf | ~has_url, "brasil_fisico").otherwise("brasil_online")
    unknown = F.when(pdf, "brasil_fisico").when(has_url, "internacional").otherwise("brasil_online")
    return F.when(name.isNull() | (name == ""), F.when(pdf, "brasil_fisico").otherwise("brasil_online")).when(foreign, "internacional").when(national, printed).otherwise(unknown)


def is_portuguese(text: Column) -> Column:
    low = F.lower(text)
    hits = reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in D.PORTUGUESE_WORDS))
    return text.isNull() | (F.char_length(text) < 40) | low.rlike("[áàâãéêíóôõúç]") | (hits / F.greatest(F.lit(1.0), F.char_length(text) / 500) >= 1)


def source_type_by_text(text: Column, has_url: Column, file_type: Column) -> Column:
    return F.when(~is_portuguese(text), "internacional").when((file_type == "pdf") | ~has_url, "brasil_fisico").otherwise("brasil_online")


def truncate(text: Column, most: int = 500, suffix: str = "...") -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix))).otherwise(text)


def excerpt(text: Column, most: int) -> Column:
    """The first characters, with dots behind them if any follow."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def first_sentence(text: Column, most: int = 120) -> Column:
    sentence = F.substring_index(text, ". ", 1)
    whole = F.when(sentence != text, F.concat(sentence, F.lit("."))).otherwise(text)
    return F.when(F.char_length(whole) <= most, whole).otherwise(F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("...")))


def source_name(outlet: Column, *fallbacks: Column, url: Column | None = None) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)) if url is not None else F.lit(None)
    return F.coalesce(*(present(strip(c)) for c in (outlet, *fallbacks)), present(host))


_CALENDAR = "lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre|segunda|terca|terça|quarta|quinta|sexta|sábado|sabado|domingo|janeiro|fevereiro|março|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"  # fixed values


def canonical_source(name: Column) -> Column:
    s = collapse(F.translate(name, "‐–", "--"))
    for pattern in (r"(?U)\b\d{4,}\b", r"(?U)\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", rf"(?iU)\b(?:{_CALENDAR})\b"):
        s = F.regexp_replace(s, pattern, "")
    s = collapse(s)
    up = F.upper(s)
    brand = (
        F.when(up.contains("GLOBO"), "O Globo")
        .when((up.contains("ESTADO") & up.contains("PAULO")) | up.contains("ESTADÃO") | up.contains("ESTADAO") | up.startswith("SP O ESTADO"), "O Estado de S. Paulo")
        .when(up.contains("VALOR") & up.contains("ECON"), "Valor Econômico")
        .when(up.contains("FOLHA") & (up.contains("S.PAULO") | up.contains("S. PAULO") | up.contains("SAO PAULO") | up.contains("SÃO PAULO")), "Folha de S.Paulo")
        .when(up.contains("WALL STREET JOURNAL"), "The Wall Street Journal")
        .when(up.contains("LES ECHOS"), "Les Echos")
    )
    junk = F.lower(s).isin("n/a", "na", "nd", "?", "-", "ela", "ines", "ines249") | (F.char_length(s) < 3)
    return F.when(name.isNull() | (name == "") | junk, None).otherwise(F.coalesce(brand, title_case(s)))


def entity_key(name: Column) -> Column:
    plain = F.translate(F.lower(strip(name)), "áàãâéêèíîóôõúûüç", "aaaaeeeiiooouuuc")
    return collapse(F.regexp_replace(plain, r"(?U)[^\w\s]", ""))


def canonical_entity(name: Column) -> Column:
    return F.coalesce(lookup(D.ENTITY_ALIASES, entity_key(name)), title_case(strip(name)))


def slug(text: Column, most: int = 60) -> Column:
    s = F.regexp_replace(F.lower(unaccent(text)), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "^-+|-+$", "")
    return F.coalesce(present(F.regexp_replace(F.substring(s, 1, most), "-+$", "")), F.lit("sem-titulo"))


def yaml_value(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(text.isNull() | (text == ""), '""').when(text.rlike(r"[:#{}\[\],&*?|><=!%@`\"']"), quoted).otherwise(text)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([_*`\[])", r"\\$1")


def page_number(page: Column) -> Column:
    return F.coalesce(F.regexp_extract(page, r"(\d+)", 1).try_cast("int"), F.lit(999999))


def pages_label(numbers: Column) -> Column:
    """'p. 4', 'p. 4-5' where pages are contiguous, 'p. 4, 7' where they aren't; '' without pages."""
    n = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x != 999999)))
    run = F.array_max(n) - F.array_min(n) + 1 == F.size(n)
    return (
        F.when(F.size(n) <= 0, "").when(F.size(n) == 1, F.concat(F.lit("p. "), F.get(n, 0).cast("string")))
        .when(run, F.concat(F.lit("p. "), F.array_min(n).cast("string"), F.lit("-"), F.array_max(n).cast("string")))
        .otherwise(F.concat(F.lit("p. "), F.array_join(F.transform(n, lambda x: x.cast("string")), ", ")))
    )


def edge_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"(?U)^\W+|\W+$", "")


def tokens(text: Column, longer_than: int = 2) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(unaccent(text)), "[^a-z0-9]+", " "))
    return F.array_distinct(F.filter(F.split(plain, " "), lambda w: F.char_length(w) > longer_than))


def keywords(text: Column) -> Column:
    """Words of more than three characters that are no stop words, without punctuation at their ends."""
    stop = F.array(*(F.lit(w) for w in D.STOPWORDS))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: (F.char_length(w) > 3) & ~F.array_contains(stop, w))
    return F.transform(words, lambda w: F.regexp_replace(w, r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$""", ""))


def after_marker(text: Column, marker: str = "Atualizado às", skip: int = 7) -> Column:
    at = F.instr(text, marker)
    cut = F.when(at > 0, text.substr(at + len(marker) + skip, F.char_length(text))).otherwise(text)
    return strip(F.replace(cut, F.lit("\n"), F.lit("")))


def contains_any(text: Column, needles: str) -> Column:
    """Comma-separated needles, any of which the text contains regardless of case; no needles: true."""
    wanted = [n.strip().lower() for n in needles.split(",") if n.strip()]
    return any_of(F.lower(text).contains(n) for n in wanted) if wanted else F.lit(True)


def trigrams(text: Column) -> Column:
    """pg_trgm's trigrams: each word is padded with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def is_journal(file_name: Column, message: Column) -> Column:
    """Whether a file of a channel looks like a paper of interest, by its name and message."""
    both = F.concat_ws(" ", F.coalesce(file_name, F.lit("")), F.coalesce(message, F.lit("")))
    return any_of(both.rlike(f"(?iU){p}") for p in D.JOURNAL_PATTERNS) | F.coalesce(F.lower(file_name).endswith(".pdf"), F.lit(False))
