"""SQL fragments shared by comparison queries."""

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(x: str, group: int) -> str:
    return f"regexp_extract({x}, '{_URL}', {group})"


def netloc(x: str) -> str:
    return f"lower({url_part(x, 2)})"


def bare_path(x: str) -> str:
    return f"regexp_replace({url_part(x, 3)}, '/+$', '')"


def identity_url(x: str) -> str:
    q = (
        f"array_to_string(list_sort(list_filter(string_split({url_part(x, 4)}, '&'), "
        "lambda v: v <> '' AND NOT regexp_matches(lower(v), '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))), '&')"
    )
    path = f"coalesce(nullif({bare_path(x)}, ''), '/')"
    return (
        f"CASE WHEN {url_part(x, 1)} = '' OR {url_part(x, 2)} = '' THEN '' ELSE lower({url_part(x, 1)}) || '://' || "
        f"{netloc(x)} || {path} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END END"
    )


def search_url(x: str) -> str:
    return f"{netloc(x)} || {bare_path(x)}"


def story_url(x: str) -> str:
    path = f"coalesce(nullif({bare_path(x)}, ''), '/')"
    return (
        f"CASE WHEN lower({url_part(x, 1)}) IN ('http', 'https') AND {url_part(x, 2)} <> '' "
        f"THEN regexp_replace({netloc(x)}, '^www\\.', '') || {path} ELSE '' END"
    )


def compact(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def identity_title(x: str) -> str:
    words = f"regexp_replace(lower({compact(x)}), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]+', ' ', 'g')"
    return f"trim(regexp_replace({words}, '[\\s\\p{{Z}}\\-—_]+', ' ', 'g'))"


def search_title(x: str) -> str:
    words = f"regexp_replace(lower({compact(x)}), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]+', ' ', 'g')"
    return f"trim(regexp_replace({words}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def article_key(title: str, link: str) -> str:
    return f"md5(coalesce(nullif({identity_url(link)}, ''), {identity_title(title)}))"


def quoted_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def tokens(x: str) -> str:
    """Story tokens of a title, sorted, as a list."""
    from tidewire.functions.tokens import GENERIC, STOPWORDS

    cut = (
        f"CASE WHEN contains(trim({x}), ' - ') THEN trim(regexp_replace(trim({x}), '[\\s\\p{{Z}}]+-[\\s\\p{{Z}}]+[A-Za-z0-9&.'' ]+$', '')) "
        f"ELSE trim({x}) END"
    )
    drop = quoted_list(STOPWORDS + GENERIC)
    return (
        f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({cut}), '[a-z0-9][a-z0-9+._\\-]*'), "
        f"lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT list_contains({drop}, t))))"
    )


def no_space(x: str) -> str:
    return f"regexp_replace({x}, '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]', '', 'g')"


def number_keys(x: str) -> str:
    """Distinct numbers as written, none directly behind a letter or digit.

    A number may take the blank or unit that the next one stands behind, so a mark goes between.
    """
    parted = f"regexp_replace({x}, '([\\s\\x0B万亿])([$¥]?[0-9])', '\\1' || chr(2) || '\\2', 'g')"
    unit = "[Tt][Rr][Ii][Ll][Ll][Ii][Oo][Nn]|[Bb][Ii][Ll][Ll][Ii][Oo][Nn]|[Mm][Ii][Ll][Ll][Ii][Oo][Nn]|[TtBbMm万亿]"
    number = f"[$¥]?[0-9]+(?:\\.[0-9]+)?[\\s\\x0B]*(?:{unit})?"
    return f"list_distinct(regexp_extract_all({parted}, '(?:^|[^A-Za-z0-9])({number})', 1))"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def alias_regex(plain=(), models=()) -> str:
    import re

    def alt(ws):
        return "|".join(re.escape(w.lower().replace("ß", "ss")).replace("\\ ", " ") for w in ws)

    parts = []
    if plain:
        parts.append(f"(?:{alt(plain)})(?:[^a-z0-9]|$)")
    if models:
        parts.append(f"(?:{alt(models)})(?:[^a-z]|$)")
    return f"(?:{'|'.join(parts)})"


def has_alias(x: str, plain=(), models=()) -> str:
    return f"regexp_matches({x}, '(?s)(?:^|[^a-z0-9]){alias_regex(plain, models)}')"


def alias_at(x: str, plain=(), models=()) -> str:
    """0-based position of the first hit, NULL without one."""
    p = f"(?s)^(.*?)(^|[^a-z0-9]){alias_regex(plain, models)}"
    return (
        f"CASE WHEN {has_alias(x, plain, models)} THEN length(regexp_extract({x}, '{p}', 1)) + "
        f"length(regexp_extract({x}, '{p}', 2)) END"
    )


def analysis(source: str, title: str, body: str, columns: str, name: str = "ana") -> str:
    """CTEs that add rel, primary_entity, ents, title_ents, fams, acts, objs, topic to rows of `source`."""
    from tidewire.queries.views import CATALOG as c

    def ents(x):
        items = ", ".join(
            f"{{'at': {alias_at(x, e.aliases, tuple(a for f in e.families for a in f.aliases))}, 'id': '{e.entity_id}'}}"
            for e in c.entities
        )
        return f"list_transform(list_sort(list_filter([{items}], lambda r: r.at IS NOT NULL)), lambda r: r.id)"

    def hits(pairs):
        cases = ", ".join(f"CASE WHEN {cond} THEN '{k}' END" for k, cond in pairs)
        return f"list_filter([{cases}], lambda v: v IS NOT NULL)"

    def ids(test):
        return quoted_list([e.entity_id for e in c.entities if test(e)])

    fams = [(f.family_id, has_alias("t2", (), f.aliases)) for e in c.entities for f in e.families]
    models = [
        (a, has_alias("t2", (), (a,))) for e in c.entities for f in e.families for a in f.aliases
    ]
    acts = [(k, has_alias("t2", v)) for k, v in c.actions.items()]
    objs = [(k, has_alias("t2", v)) for k, v in c.objects.items()]
    labs = ids(lambda e: e.tier == "frontier_lab")
    direct = ids(lambda e: e.tier == "frontier_lab" and not e.requires_ai_context)
    infra = ids(lambda e: e.tier == "ai_infrastructure" and not e.requires_ai_context)
    regions = "CASE r " + " ".join(f"WHEN '{e.entity_id}' THEN '{e.region}'" for e in c.entities) + " END"
    return f"""{name}0 AS (SELECT {columns}, {fold(title)} AS t1, {fold(f"{title} || chr(10) || {body}")} AS t2 FROM {source}),
{name}1 AS (SELECT *, {ents('t2')} AS ents, {ents('t1')} AS title_ents, list_sort({hits(fams)}) AS fams, list_sort({hits(models)}) AS models,
  {hits(acts)} AS acts, {hits(objs)} AS objs, {has_alias('t2', c.core_terms)} AS core, {has_alias('t2', c.neighbor_terms)} AS near FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN len(fams) > 0 OR list_has_any(ents, {direct}) THEN 3
   WHEN core OR (list_has_any(ents, {labs}) AND near) THEN 2 WHEN near OR list_has_any(ents, {infra}) THEN 2
   WHEN len(ents) > 0 THEN 1 ELSE 0 END AS rel, coalesce(title_ents[1], ents[1], '') AS primary_entity,
   list_sort(list_distinct(list_transform(ents, lambda r: {regions}))) AS regions FROM {name}1),
{name} AS (SELECT * EXCLUDE (t1, t2), CASE WHEN list_has_any(acts, ['lawsuit', 'policy']) THEN 'legal_policy'
   WHEN list_has_any(acts, ['recall', 'security']) THEN 'safety_security' WHEN list_has_any(objs, ['robotaxi', 'humanoid']) THEN 'robotics_autonomy'
   WHEN list_has_any(acts, ['research', 'benchmark']) THEN 'research_benchmark' WHEN list_contains(objs, 'data_center') THEN 'infrastructure'
   WHEN list_has_any(acts, ['funding', 'deal']) THEN 'funding_business' WHEN list_has_any(acts, ['access', 'integrate', 'rename']) THEN 'product_access'
   WHEN list_has_any(acts, ['release', 'train']) THEN 'model_release' WHEN rel >= 2 THEN 'other_ai' ELSE 'general_technology' END AS topic FROM {name}2)"""


def body_sql() -> str:
    return "concat_ws(chr(10), nullif(trim(description), ''), nullif(trim(content), ''))"
