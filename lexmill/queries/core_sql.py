"""The core queries in DuckDB's SQL, written from the rules, over whole tables."""

from __future__ import annotations

from lexmill.functions import fixed
from lexmill.operators.annotate import IRREGULAR_LEMMAS

STRIP = r"regexp_replace({0}, '^[\s\x{{00A0}}\x{{3000}}]+|[\s\x{{00A0}}\x{{3000}}]+$', '', 'g')"


def strip(e: str) -> str:
    return STRIP.format(e)


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


CLEAN = r"trim(lower(regexp_replace(regexp_replace(coalesce({0}, ''), '[^\p{{L}}\p{{N}}_\s''-]', ' ', 'g'), '\s+', ' ', 'g')))"
TOKENS = (
    r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || {0} || ' ', '--+', ' ', 'g'), "
    r"' cannot ', ' can not ', 'g'), 'n''t ', ' ', 'g'), '''(s|m|d|ll|re|ve)? ', ' ', 'g'), '\s+'), lambda w: regexp_matches(w, '^\p{{L}}{{2,}}$'))"
)
TOK = f"tok AS (SELECT row_id, {CLEAN.format('content')} AS clean, {TOKENS.format(CLEAN.format('content'))} AS ws FROM passages)"


def ngram_cte(lengths) -> str:
    parts = [
        f"SELECT {n} AS length, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS pattern "
        f"FROM tok WHERE length(clean) >= 5 AND len(ws) >= {n}"
        for n in lengths
    ]
    least = "CASE length " + " ".join(f"WHEN {n} THEN {fixed.MIN_FREQUENCY[n]}" for n in lengths) + " END"
    return (
        f"{TOK}, grams AS ({' UNION ALL '.join(parts)}), counts AS (SELECT length, pattern, count(*) AS frequency FROM grams "
        f"WHERE NOT regexp_matches(pattern, '^(a|an|the) | (a|an|the)$') GROUP BY length, pattern HAVING count(*) >= {least})"
    )


def either(parts, template: str) -> str:
    return "(" + " OR ".join(template.format(p.replace("'", "''")) for p in parts) + ")"


def category(p: str) -> str:
    has = f"contains({p}, '{{0}}')"
    return (
        f"CASE WHEN {either(fixed.CATEGORY_LINK[1], has)} THEN '{fixed.CATEGORY_LINK[0]}' "
        f"WHEN {either(fixed.CATEGORY_PREPOSITION[1], f'starts_with({p}, {chr(39)}{{0}}{chr(39)})')} THEN '{fixed.CATEGORY_PREPOSITION[0]}' "
        f"WHEN {either(fixed.CATEGORY_TIME[1], has)} THEN '{fixed.CATEGORY_TIME[0]}' "
        f"WHEN {either(fixed.CATEGORY_CONDITION[1], has)} THEN '{fixed.CATEGORY_CONDITION[0]}' "
        f"WHEN len(string_split({p}, ' ')) = 2 AND {either(fixed.CATEGORY_VERB[1], has)} THEN '{fixed.CATEGORY_VERB[0]}' "
        f"WHEN {either(fixed.CATEGORY_ACADEMIC[1], has)} THEN '{fixed.CATEGORY_ACADEMIC[0]}' ELSE '{fixed.CATEGORY_OTHER}' END"
    )


def score() -> str:
    weights = "CASE length " + " ".join(f"WHEN {n} THEN {w}::DOUBLE" for n, w in fixed.LENGTH_WEIGHTS.items()) + " END"
    bonus = "CASE " + " ".join(f"WHEN regexp_matches(pattern, '{r}') THEN {b}::DOUBLE" for r, b in fixed.PATTERN_BONUSES) + " ELSE 0.0::DOUBLE END"
    prep = f"CASE WHEN list_has_any(string_split(pattern, ' '), [{quoted(fixed.PREPOSITIONS)}]) THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END"
    return f"(frequency + {prep}) * {weights} + {bonus}"


def pos_case(w: str) -> str:
    lexical = " ".join(f"WHEN {w} IN ({quoted(words)}) THEN '{tag}'" for tag, words in fixed.TAGGED_WORDS)
    suffix = " ".join(f"WHEN length({w}) > 4 AND {either(ends, f'ends_with({w}, {chr(39)}{{0}}{chr(39)})')} THEN '{tag}'" for tag, ends in fixed.POS_OF_SUFFIX)
    return f"CASE {lexical} {suffix} ELSE 'NOUN' END"


def important(tags: str) -> str:
    return "(" + " OR ".join(f"{tags}[1:{len(seq)}] = [{quoted(seq)}]" for seq in fixed.POS_SEQUENCES) + ")"


def top(source: str, more: str = "") -> str:
    return (
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY educational_score DESC, pattern) AS rank FROM (SELECT *, {score()} AS educational_score FROM {source})), "
        f"best AS (SELECT length, pattern, frequency, round(educational_score, 2) AS educational_score, rank, {category('pattern')} AS category{more} FROM ranked WHERE rank <= 200)"
    )


def terms(*kinds: str) -> str:
    return f"(SELECT DISTINCT lower({strip('term')}) AS term FROM lexicon WHERE kind IN ({quoted(kinds)}) AND term IS NOT NULL AND NOT starts_with(term, '#'))"


_UNDO = "CASE WHEN regexp_matches({0}, '(bb|dd|gg|mm|nn|pp|rr|tt)$') THEN left({0}, length({0}) - 1) ELSE {0} END"


def lemma(w: str) -> str:
    forms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR_LEMMAS.items())
    return (
        f"coalesce(CASE {w} {forms} END, "
        f"CASE WHEN regexp_matches({w}, '[^aeiou]ies$') THEN left({w}, length({w}) - 3) || 'y' WHEN regexp_matches({w}, '(s|x|z|ch|sh)es$') THEN left({w}, length({w}) - 2) "
        f"WHEN regexp_matches({w}, '[^su]s$') AND length({w}) > 3 THEN left({w}, length({w}) - 1) WHEN regexp_matches({w}, '[^aeiou]ied$') THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN regexp_matches({w}, '[aeiouy][^aeiou]+ed$') AND length({w}) > 4 THEN {_UNDO.format(f'left({w}, length({w}) - 2)')} "
        f"WHEN regexp_matches({w}, '[aeiouy][^aeiou]*ing$') AND length({w}) > 5 THEN {_UNDO.format(f'left({w}, length({w}) - 3)')} ELSE {w} END)"
    )


FREQ = (
    f"{TOK}, places AS (SELECT row_id, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos FROM tok), "
    f"counted AS (SELECT token, count(*) AS n, min({{'id': row_id, 'pos': pos}}) AS f FROM places WHERE length(token) >= 3 "
    f"AND token NOT IN (SELECT term FROM {terms('easy')}) GROUP BY token), "
    f"freq AS (SELECT {lemma('token')} AS lemma, sum(n)::BIGINT AS frequency, min(f) AS f FROM counted GROUP BY 1), "
    "ranks AS (SELECT lemma, frequency, row_number() OVER (ORDER BY frequency DESC, f) AS rank, count(*) OVER () AS n FROM freq), "
    "tiers AS (SELECT lemma, frequency, rank, CASE WHEN rank <= n * 0.05::DOUBLE THEN 1.0::DOUBLE WHEN rank <= n * 0.2::DOUBLE THEN 2.0 WHEN rank <= n * 0.5::DOUBLE THEN 3.0 "
    "ELSE 4.0 + (rank - n * 0.5::DOUBLE) / (n * 0.5::DOUBLE) END AS tier FROM ranks)"
)

# places of tokens: lengths of the tokens and of what stands between them, summed up
PLACES = r"""
raw AS (SELECT row_id AS id, content AS text, regexp_extract_all(content, '[\p{L}\p{N}_]+') AS ts, regexp_split_to_array(content, '[\p{L}\p{N}_]+') AS gs
        FROM passages WHERE content IS NOT NULL),
one AS (SELECT id, text, ts, unnest(ts) AS t, unnest(gs[1:len(ts)]) AS g, generate_subscripts(ts, 1) AS i FROM raw),
placed AS (SELECT id, text, ts, i, lower(t) AS w, t, (sum(length(t) + length(g)) OVER (PARTITION BY id ORDER BY i) - length(t))::INT AS s FROM one)
"""


def hit_cte(source: str, name: str = "hit") -> str:
    """(id, term, start, end) of the terms of ``source``, from the tokens of PLACES."""
    return rf"""{name}_lex AS (SELECT term, regexp_extract_all(term, '[\p{{L}}\p{{N}}_]+') AS parts FROM {source}),
    {name}_first AS (SELECT * FROM {name}_lex WHERE len(parts) > 0 AND regexp_matches(term, '^[\p{{L}}\p{{N}}_]') AND regexp_matches(term, '[\p{{L}}\p{{N}}_]$')),
    {name} AS (SELECT a.id, term, a.s AS start, (a.s + length(term))::INT AS "end"
            FROM placed a JOIN {name}_first ON a.w = parts[1]
            WHERE lower(substring(a.text, a.s + 1, length(term))) = term
              AND list_transform(a.ts[a.i:a.i + len(parts) - 1], lambda x: lower(x)) = parts)"""


def hits(kinds: str) -> str:
    return f"{PLACES}, {hit_cte(kinds)}"


WORDS = f"words AS (SELECT DISTINCT lower({strip('word')}) AS word FROM workbook WHERE regexp_matches(lower({strip('word')}), '^[a-z]+$'))"


def root(w: str, irregular: dict[str, str] = fixed.MORE_IRREGULAR_ROOTS, suffixes=fixed.ROOT_SUFFIXES, least: int = 3) -> str:
    forms = " ".join(f"WHEN '{f}' THEN '{r}'" for f, r in irregular.items())
    cuts = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) > {len(s) + 2} AND length({w}) >= {len(s) + least} THEN left({w}, length({w}) - {len(s)})" for s in suffixes)
    return f"coalesce(CASE {w} {forms} END, CASE {cuts} ELSE {w} END)"


LISTED = (
    f"cand AS (SELECT entry_id, {strip('word')} AS word, list_filter(list_transform(string_split(synonyms, ','), lambda x: {strip('x')}), lambda x: length(x) > 0) AS c "
    "FROM workbook WHERE word IS NOT NULL AND synonyms IS NOT NULL)"
)
FORM = "regexp_matches(x, '^[a-zA-Z'']+$') AND length(x) BETWEEN 3 AND 12 AND lower(x) <> lower(word) AND NOT (upper(x) = x AND regexp_matches(x, '[A-Z]'))"
BASIC = f"regexp_matches(x, '^[a-zA-Z'']+$') AND length(x) BETWEEN 3 AND 12 AND lower(x) <> lower(word) AND lower(x) NOT IN ({quoted(fixed.COMMON_SYNONYMS)})"
SIMILAR = "CASE WHEN abs(length({0}) - length({1})) > 3 THEN false ELSE levenshtein({0}, {1}) / greatest(length({0}), length({1})) < 0.3::DOUBLE END"
COMPOUND = r"(length({0}) >= 4 AND regexp_matches({0}, '[\p{{L}}\p{{N}}_](\s+|-)[\p{{L}}\p{{N}}_]|[\p{{L}}\p{{N}}]_[\p{{L}}\p{{N}}]'))"


def deduped(listed: str, source: str = "cand") -> str:
    """Keep a candidate if no earlier one, nor the word, has its root."""
    return (
        f"f AS (SELECT entry_id, word, {listed} AS c FROM {source}), x AS (SELECT entry_id, word, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM f), "
        f"r AS (SELECT *, {root('lower(c)')} AS root, {root('lower(word)')} AS own FROM x), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY entry_id, root ORDER BY i) AS nth FROM r WHERE root <> own), "
        "kept AS (SELECT f.entry_id, coalesce(list(k.c ORDER BY k.i) FILTER (WHERE k.c IS NOT NULL), []) AS c FROM f LEFT JOIN k ON k.entry_id = f.entry_id AND nth = 1 GROUP BY f.entry_id)"
    )


PROBLEM = (
    f"CASE WHEN ends_with(m, '의미') THEN 'generic_meaning_pattern' WHEN regexp_matches(m, '[a-zA-Z]') THEN 'contains_english' "
    "WHEN length(m) < 2 THEN 'missing_or_too_short' WHEN length(m) > 30 THEN 'too_long' END"
)
MEANINGS = f"mp AS (SELECT *, {PROBLEM} AS problem_type FROM (SELECT entry_id, word, meaning_ko, coalesce({strip('meaning_ko')}, '') AS m FROM workbook))"
MISSING = f"coalesce(lower({strip('synonyms')}) IN ('', 'nan', 'none'), true)"
DUPLICATES = "dup AS (SELECT passage_id, word, count(*) AS n, list(entry_id ORDER BY entry_id) AS ids FROM workbook GROUP BY passage_id, word HAVING count(*) > 1)"
CONFLICTS = (
    f"keys AS (SELECT DISTINCT passage_id, lower({strip('word')}) AS w FROM workbook WHERE passage_id IS NOT NULL AND word IS NOT NULL), "
    r"parts AS (SELECT DISTINCT passage_id, w AS idiom, unnest(regexp_split_to_array(w, '\s+')) AS part FROM keys WHERE contains(w, ' ')), "
    "con AS (SELECT p.passage_id, p.idiom, k.w AS word FROM parts p JOIN keys k ON k.passage_id = p.passage_id AND k.w = p.part WHERE NOT contains(k.w, ' '))"
)
COUNTS = (
    f"{DUPLICATES}, {CONFLICTS}, {MEANINGS}, b AS (SELECT (SELECT count(*) FROM workbook) AS total_entries, (SELECT count(*) FROM dup) AS duplicates, "
    f"(SELECT count(*) FROM con) AS conflicts, (SELECT count(*) FROM mp WHERE problem_type IS NOT NULL) AS meanings, "
    f"(SELECT count(*) FROM workbook WHERE {MISSING}) AS synonyms, 0 AS contexts, 0 AS accuracy)"
)
LOST = " + ".join(f"{k} / total_entries::DOUBLE * {w}" for k, w in fixed.PENALTIES.items())


def pos_letter() -> str:
    p = f"lower({strip('pos')})"
    return "CASE " + " ".join(f"WHEN {p} IN ({quoted(labels.split())}) THEN '{letter}'" for letter, labels in fixed.POS_LETTERS.items()) + f" ELSE {p} END"


def clean_meaning() -> str:
    e = "meaning_ko"
    for label in fixed.MEANING_LABELS:
        e = strip(f"replace({e}, '{label}', '')")
    return f"""WITH c AS (SELECT entry_id, word, regexp_replace({e}, '^["'']+|["'']+$', '', 'g') AS t FROM workbook WHERE word IS NOT NULL AND meaning_ko IS NOT NULL)
        SELECT entry_id, CASE WHEN regexp_matches(t, '[a-zA-Z]') OR length(t) > 20 OR length(t) < 1 THEN word || '{fixed.GENERIC_MEANING}' ELSE t END AS meaning FROM c"""


KV = "kv AS (SELECT event_type AS namespace, user_id::VARCHAR AS key, event_id::VARCHAR AS value_json, ts AS created_at FROM events)"
LAST = "row_number() OVER (PARTITION BY namespace, key ORDER BY {0}created_at DESC, value_json DESC) AS nth"


def separable_sql(pairs: str, name: str = "sep") -> str:
    return rf"""
    sraw AS (SELECT row_id AS id, regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+') AS ts, regexp_split_to_array(content, '[\p{{L}}\p{{N}}_]+') AS gs FROM passages WHERE content IS NOT NULL),
    sone AS (SELECT id, unnest(ts) AS t, unnest(gs[1:len(ts)]) AS g, generate_subscripts(ts, 1) AS i FROM sraw),
    stok AS (SELECT id, i, lower(t) AS w, length(t) AS n, sum(length(t) + length(g)) OVER o - length(t) AS s, sum(length(regexp_replace(g, '[^.!?;:]', '', 'g'))) OVER o AS marks,
             lead(lower(t)) OVER o AS following FROM sone WINDOW o AS (PARTITION BY id ORDER BY i)),
    pairs AS ({pairs}),
    v AS (SELECT stok.*, verb, particle FROM stok JOIN pairs ON w = verb),
    p AS (SELECT v.id, v.verb, v.particle, v.s AS start, b.s + b.n AS "end", b.i - v.i - 1 AS gap, v.following, v.marks AS before, b.marks AS behind,
                 row_number() OVER (PARTITION BY v.id, v.i, v.verb, v.particle ORDER BY b.i) AS nth
          FROM v JOIN stok b ON b.id = v.id AND b.w = v.particle AND b.i BETWEEN v.i + 1 AND v.i + 7),
    {name} AS (SELECT id, verb, particle, start::INT AS start, "end"::INT AS "end", gap::INT AS gap, CASE WHEN gap = 0 THEN 'continuous' WHEN gap = 1 AND following IN ({quoted(fixed.GAP_PRONOUNS)}) THEN 'separated_pronoun'
            WHEN gap >= 3 THEN 'separated_long_noun' ELSE 'separated_noun' END AS pattern_type FROM p WHERE nth = 1 AND before = behind)"""


def kept_apart(source: str, gap: int, name: str) -> str:
    """Of (id, term, start, end): longest term first, each whose start is ``gap`` or more from all kept before."""
    near = f"len(list_filter(acc, lambda a: abs(a.start - x[1].start) < {gap})) > 0"
    return (
        f"{name}_l AS (SELECT id, list({{'term': term, 'start': start, 'end': \"end\"}} ORDER BY -length(term), term, start, \"end\") AS l FROM {source} GROUP BY id), "
        f"{name}_k AS (SELECT id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN {near} THEN acc ELSE list_concat(acc, x) END)) AS k FROM {name}_l), "
        f'{name} AS (SELECT id, k.term AS term, k.start AS start, k."end" AS "end" FROM {name}_k)'
    )


def workbook_sql(full: bool) -> str:
    """The whole program: matches of all kinds, rows, then conflicts and duplicates repaired."""
    easy = terms("easy")
    pairs = (
        f"SELECT DISTINCT string_split(term, ' ')[1] AS verb, string_split(term, ' ')[2] AS particle FROM {terms('user_idiom')} "
        f"WHERE len(string_split(term, ' ')) = 2 AND string_split(term, ' ')[2] IN ({quoted(fixed.PARTICLES)})"
    )
    parts = [
        PLACES,
        separable_sql(pairs),
        "sepm AS (SELECT id, verb || ' ' || particle AS term, start, \"end\" FROM sep)",
        kept_apart("sepm", 6, "k1"),
        f"plain AS (SELECT term FROM {terms('user_idiom')} WHERE term NOT IN (SELECT verb || ' ' || particle FROM pairs))",
        hit_cte("plain", "h2"),
        kept_apart("h2", 5, "k2"),
        hit_cte(terms("user_word"), "h3"),
        kept_apart("h3", 3, "k3"),
    ]
    every = [
        "SELECT id, 1 AS kind, start, \"end\", CASE WHEN \"end\" - start > length(term) THEN replace(term, ' ', ' ~ ') ELSE term END AS base_form, \"end\" - start > length(term) AS is_separated FROM k1",
        "SELECT id, 2, start, \"end\", term, false FROM k2",
        "SELECT id, 3, start, \"end\", term, false FROM k3",
    ]
    if full:
        parts += [
            f"r4 AS (SELECT row_id AS id, term, instr(lower(content), term) - 1 AS start, instr(lower(content), term) - 1 + length(term) AS \"end\" FROM passages, "
            f"(SELECT term FROM {terms('reference_idiom')} WHERE term <> '' ORDER BY term LIMIT 50) WHERE contains(lower(content), term))",
            kept_apart("r4", 10, "k4"),
            rf"k5 AS (SELECT id, w AS term, s AS start, s + length(t) AS \"end\" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS nth FROM placed "
            rf"WHERE regexp_matches(t, '^\p{{L}}{{3,}}$') AND NOT regexp_matches(t, '^\p{{Lu}}') AND w NOT IN (SELECT term FROM {easy})) WHERE nth <= 10 AND length(t) >= 5)".replace('\\"', '"'),
        ]
        every += ["SELECT id, 4, start, \"end\", term, false FROM k4", "SELECT id, 5, start, \"end\", term, false FROM k5"]
    types = {1: "separable", 2: "idiom_exact", 3: "word_exact", 4: "reference_idiom", 5: "difficult_word"}
    confidence = {1: 0.9, 2: 0.95, 3: 1.0, 4: 0.9, 5: 0.8}

    def of_kind(values: dict) -> str:
        return "CASE kind " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in values.items()) + " END"

    tag = f"CASE {pos_case('lower(original)')} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SIMPLE_POS.items()) + f" ELSE '{fixed.OTHER_POS}' END"
    context = strip("regexp_extract(left(content, start), '[^.]*$') || substring(content, start + 1, \"end\" - start) || regexp_extract(substring(content, \"end\" + 1), '^[^.]*')")
    made = {
        "textbook_id": "textbook_id::DOUBLE", "book_title": "book_title", "passage_id": "textbook_studio_passage_id", "seq": "seq",
        "passage_preview": "CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END", "word": "original", "base_form": "base_form",
        "pos": f"CASE WHEN kind IN (3, 5) THEN {tag} ELSE '' END", "meaning_ko": f"original || '{fixed.GENERIC_MEANING}'", "meaning_en": "''", "synonyms": "''", "antonyms": "''",
        "context": context, "is_separated": "is_separated", "confidence": f"{of_kind(confidence)}::DOUBLE", "user_db_match": "kind <= 3", "match_type": of_kind(types),
        "pattern_info": "'Studio: ' || coalesce(studio_title, '') || ', Unit: ' || coalesce(textbook_unit_id, '')", "contextual_meaning": "''", "synonym_confidence": "0.0::DOUBLE",
        "process_method": "'lexicon'", "inclusion_reason": "CASE WHEN kind <= 3 THEN '사용자DB매칭' WHEN kind = 4 THEN '참조숙어' ELSE '난이도' END",
    }
    key = f"lower({strip('word')})"
    parts += [
        f"every AS ({' UNION ALL '.join(every)})",
        f"joined AS (SELECT e.*, p.*, row_number() OVER (PARTITION BY id ORDER BY kind, start, \"end\", base_form) AS seq, substring(content, start + 1, \"end\" - start) AS original "
        f"FROM every e JOIN passages p ON p.row_id = e.id WHERE length({strip('content')}) >= 10)",
        "wb AS (SELECT row_id, " + ", ".join(f"{e} AS {n}" for n, e in made.items()) + " FROM joined)",
        f"wkeys AS (SELECT DISTINCT passage_id, {key} AS w FROM wb WHERE passage_id IS NOT NULL)",
        r"wparts AS (SELECT DISTINCT passage_id, unnest(regexp_split_to_array(w, '\s+')) AS part FROM wkeys WHERE contains(w, ' '))",
        f"kept AS (SELECT * FROM wb WHERE NOT EXISTS (SELECT 1 FROM wparts WHERE wparts.passage_id = wb.passage_id AND part = {key}))",
    ]
    return (
        f"WITH {', '.join(parts)} SELECT row_id, {', '.join(made)} FROM kept "
        "QUALIFY passage_id IS NULL OR row_number() OVER (PARTITION BY passage_id, word ORDER BY length(context) DESC, row_id, seq) = 1"
    )


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["passage_scan"] = (
        f"WITH p AS (SELECT row_id, coalesce(textbook_studio_passage_id, 'text_' || coalesce(textbook_id::VARCHAR, 'nan')) AS id, {strip('content')} AS c FROM passages) "
        "SELECT row_id, id, CASE WHEN length(c) > 100 THEN left(c, 100) || '...' ELSE c END AS preview, length(c) AS n_chars FROM p WHERE length(c) >= 10"
    )
    for n in (2, 3, 4, 5):
        out[f"ngram_{n}"] = f"WITH {ngram_cte((n,))} SELECT pattern, frequency FROM counts"
    every = ngram_cte((2, 3, 4, 5))
    out["pattern_top"] = f"WITH {every}, {top('counts')} SELECT * FROM best"
    tagged = f"tagged AS (SELECT *, list_transform(string_split(pattern, ' '), lambda w: {pos_case('w')}) AS tags FROM counts), chosen AS (SELECT *, {important('tags')} AS is_important FROM tagged WHERE {important('tags')} OR frequency >= 5)"
    out["pattern_top_pos"] = f"WITH {every}, {tagged}, {top('chosen', ', array_to_string(tags, ' + chr(39) + ' -> ' + chr(39) + ') AS pos_pattern, is_important')} SELECT * FROM best"
    out["pattern_category_counts"] = f"WITH {every}, {top('counts')} SELECT category AS value, count(*) AS n FROM best GROUP BY category"
    out["frequency_tiers"] = f"WITH {FREQ} SELECT lemma, frequency, rank, round(tier, 6) AS tier FROM tiers"
    out["tier_histogram"] = f"WITH {FREQ} SELECT floor(tier)::BIGINT AS tier_floor, count(*) AS n, sum(frequency)::BIGINT AS frequency FROM tiers GROUP BY 1"
    out["lexicon_split"] = (
        f"SELECT DISTINCT t AS term, CASE WHEN n >= 2 THEN 'idiom' ELSE 'word' END AS kind, n AS n_words FROM (SELECT t, len(list_filter(string_split(t, ' '), lambda w: length(w) > 0)) AS n "
        f"FROM (SELECT lower({strip('term')}) AS t FROM lexicon) WHERE length(t) > 0)"
    )
    out["lexicon_union"] = (
        f"SELECT term, min(source) AS source FROM (SELECT lower({strip('term')}) AS term, 'lexicon' AS source FROM lexicon WHERE term IS NOT NULL "
        f"UNION ALL SELECT unnest([{quoted(fixed.BASIC_WORDS)}]), 'basic') GROUP BY term"
    )
    out["idiom_filter"] = (
        f"SELECT DISTINCT phrase FROM (SELECT lower({strip('p_name')}) AS phrase FROM part) WHERE len(regexp_split_to_array(phrase, '\\s+')) BETWEEN 2 AND 8 AND length(phrase) <= 100 "
        "AND regexp_matches(regexp_replace(phrase, '[ -]', '', 'g'), '^\\p{L}+$')"
    )
    out["idiom_lines"] = (
        f"SELECT DISTINCT lower({strip('term')}) AS phrase FROM lexicon WHERE len(regexp_split_to_array(lower({strip('term')}), '\\s+')) BETWEEN 2 AND 8 AND length(term) <= 100 "
        "AND NOT regexp_matches(term, '^(#|//)')"
    )
    out["basic_word_semi"] = f"WITH {FREQ} SELECT lemma, frequency FROM freq WHERE lemma IN ({quoted(fixed.BASIC_WORDS)})"
    out["easy_word_anti"] = (
        f"WITH {TOK}, w AS (SELECT unnest(ws) AS token FROM tok), l AS (SELECT {lemma('token')} AS lemma FROM w WHERE length(token) >= 3) SELECT lemma, count(*) AS frequency FROM l "
        f"WHERE NOT EXISTS (SELECT 1 FROM lexicon WHERE lower({strip('term')}) = lemma) GROUP BY lemma"
    )
    out["user_word_hits"] = f"WITH {hits(terms('user_word'))} SELECT * FROM hit"
    out["user_idiom_hits"] = f"WITH {hits(terms('user_idiom', 'reference_idiom'))} SELECT * FROM hit"
    out["span_suppressed"] = (
        f"WITH {hits(terms('user_word', 'user_idiom', 'reference_idiom'))}, s AS (SELECT id, list({{'o': -length(term), 'term': term, 'start': start, 'end': \"end\"}} ORDER BY -length(term), term, start, \"end\") AS l FROM hit GROUP BY id), "
        "f AS (SELECT id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: abs(a.start - x[1].start) < 5)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM s) "
        'SELECT id, k.start AS start, k."end" AS "end", k.term AS term FROM f'
    )
    out["sentence_context"] = (
        f"WITH {hits(terms('user_word'))} SELECT hit.id, term, start, "
        + strip("regexp_extract(left(p.content, start), '[^.]*$') || substring(p.content, start + 1, \"end\" - start) || regexp_extract(substring(p.content, \"end\" + 1), '^[^.]*')")
        + " AS context FROM hit JOIN passages p ON p.row_id = hit.id"
    )
    out["reference_idiom_first"] = (
        f"WITH t AS (SELECT term FROM {terms('reference_idiom')} WHERE term <> '' ORDER BY term LIMIT 50) SELECT row_id AS id, term, instr(lower(content), term) - 1 AS start FROM passages, t WHERE contains(lower(content), term)"
    )
    lexicon_pairs = (
        f"SELECT DISTINCT string_split(term, ' ')[1] AS verb, string_split(term, ' ')[2] AS particle FROM {terms('user_idiom', 'reference_idiom')} "
        f"WHERE len(string_split(term, ' ')) = 2 AND string_split(term, ' ')[2] IN ({quoted(fixed.PARTICLES)})"
    )
    out["separable_hits"] = f"WITH {separable_sql(lexicon_pairs)} SELECT * FROM sep"
    verbs = sorted({p.split()[0] for p in fixed.OPTIONAL_SEPARABLE} | set(fixed.MANDATORY_SEPARABLE))
    particles = sorted({p.split()[1] for p in fixed.OPTIONAL_SEPARABLE} | {"out", "back", "away", "apart", "about"})
    must = "(" + " OR ".join(f"(verb = '{v}' AND particle IN ({quoted(ps)}))" for v, ps in fixed.MANDATORY_SEPARABLE.items()) + ")"
    optional = f"verb || ' ' || particle IN ({quoted(fixed.OPTIONAL_SEPARABLE)})"
    grid = f"SELECT * FROM (SELECT unnest([{quoted(verbs)}]) AS verb), (SELECT unnest([{quoted(particles)}]) AS particle)"
    out["phrasal_class"] = (
        f"WITH {separable_sql(grid)} SELECT id, start, CASE WHEN {optional} THEN 'optional_separable' WHEN {must} THEN 'mandatory_separable' WHEN gap > 0 THEN 'actually_separated' ELSE 'continuous' END AS pattern_type, "
        f"verb || ' ' || particle AS base_form, CASE WHEN NOT {optional} AND ({must} OR gap > 0) THEN verb || ' ~ ' || particle ELSE verb || ' ' || particle END AS display_form, NOT {optional} AND ({must} OR gap > 0) AS is_separated FROM sep"
    )
    out["vocabulary_workbook_lexicon"], out["vocabulary_workbook_full"] = workbook_sql(False), workbook_sql(True)
    out["phonetic_complexity"] = (
        f"WITH {WORDS} SELECT word, round(0.5 * coalesce(list_sum(list_transform(regexp_extract_all(word, '[bcdfghjklmnpqrstvwxyz]+'), lambda r: length(r) - 1)), 0)::DOUBLE "
        f"+ 0.3 * ({' + '.join(f'contains(word, {chr(39)}{g}{chr(39)})::INT' for g in fixed.DIGRAPHS)})::DOUBLE, 4) AS complexity FROM words"
    )
    points = (
        "CASE WHEN length(word) <= 4 THEN 1 WHEN length(word) <= 6 THEN 2 WHEN length(word) <= 8 THEN 3 ELSE 4 END "
        f"+ 2 * regexp_matches(word, '({'|'.join(fixed.HARD_SUFFIXES)})$')::INT + regexp_matches(word, '^({'|'.join(fixed.HARD_PREFIXES)})')::INT + regexp_matches(word, '({'|'.join(fixed.HARD_ROOTS)})')::INT"
    )
    out["word_difficulty"] = f"WITH {WORDS} SELECT word, CASE WHEN p <= 2 THEN 'elementary' WHEN p <= 4 THEN 'intermediate' ELSE 'advanced' END AS difficulty FROM (SELECT word, {points} AS p FROM words)"
    out["word_pos"] = f"WITH {WORDS} SELECT word, {pos_case('word')} AS pos FROM words"
    out["word_lemmas"] = f"WITH {WORDS} SELECT word, {lemma('word')} AS lemma FROM words"
    out["stop_and_names"] = (
        rf"WITH raw AS (SELECT regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+') AS ts FROM passages WHERE content IS NOT NULL), one AS (SELECT unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM raw) "
        rf"SELECT {pos_case('lower(t)')} AS tag, lower(t) IN (SELECT term FROM {terms('easy')}) AS is_stop, regexp_matches(t, '^\p{{Lu}}\p{{L}}+') AND i > 1 AS is_name, count(*) AS n FROM one GROUP BY 1, 2, 3"
    )
    out["attached_synonyms"] = (
        "WITH r AS (SELECT lower(word) AS w, arg_max({'s': synonyms, 'a': antonyms}, {'t': created_at, 'i': record_id}) AS r FROM synonym_records GROUP BY 1), "
        "j AS (SELECT entry_id, coalesce(array_to_string(r.s, ','), synonyms) AS synonyms, coalesce(array_to_string(r.a, ','), antonyms) AS antonyms FROM workbook LEFT JOIN r ON lower(workbook.word) = w) "
        f"SELECT *, CASE WHEN {MISSING} THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS synonym_confidence FROM j"
    )
    user, easy = f"word IN (SELECT term FROM {terms('user_word')})", f"word IN (SELECT term FROM {terms('easy')})"
    basic = f"word IN ({quoted(fixed.BASIC_WORDS)})"
    out["difficulty_cascade"] = (
        f"WITH {WORDS}, c AS (SELECT word, CASE WHEN {user} THEN '사용자DB' WHEN {basic} THEN '기본어휘제외' WHEN {easy} THEN '외부DB제외' WHEN length(word) < 4 THEN '길이부족' ELSE '적합' END AS reason FROM words) "
        "SELECT word, reason IN ('사용자DB', '적합') AS ok, reason FROM c"
    )
    out["too_easy_words"] = (
        f"WITH {WORDS}, t AS (SELECT word, {pos_case('word')} AS pos FROM words) SELECT word, pos, {basic} OR {easy} OR length(word) <= 2 OR pos IN ({quoted(fixed.EASY_TAGS)}) AS too_easy FROM t"
    )
    out["difficult_words"] = f"WITH {WORDS} SELECT word, length(word) >= 4 AND NOT {easy} AS is_difficult FROM words"
    out["difficulty_baseline"] = (
        f"WITH d AS (SELECT term FROM {terms('user_word')} WHERE NOT regexp_matches(term, '[ -]') ORDER BY md5('42:' || term), term LIMIT 15) "
        "SELECT avg(length(term)) AS average, greatest(3.0, avg(length(term)) - 1.5) AS threshold FROM d"
    )
    out["vocabulary_level"] = (
        f"WITH w AS (SELECT {strip(chr(99) + 'oalesce(word, ' + chr(39) * 2 + ')')} AS w FROM workbook), a AS (SELECT avg(length(w)) FILTER (WHERE w <> '') AS l, "
        f"count(*) FILTER (WHERE length(w) >= 2 AND (regexp_matches(w, '({'|'.join(fixed.HARD_SUFFIXES)})$') OR regexp_matches(w, '^({'|'.join(fixed.HARD_PREFIXES)})') OR length(w) > 8)) / count(*) FILTER (WHERE length(w) >= 2)::DOUBLE AS c FROM w) "
        "SELECT round(l, 6) AS avg_length, round(c, 6) AS complex_share, CASE WHEN l > 7 AND c > 0.3 THEN 'advanced' WHEN l > 5.5 AND c > 0.15 THEN 'intermediate' ELSE 'elementary' END AS level FROM a"
    )
    for name, test in (("synonym_filter_basic", BASIC), ("synonym_filter_form", FORM)):
        out[name] = f"WITH {LISTED} SELECT entry_id, array_to_string(list_filter(c, lambda x: {test}), ',') AS kept FROM cand"
    strict = f"list_filter(c, lambda x: {FORM} AND NOT ({SIMILAR.format('lower(x)', 'lower(word)')}) AND NOT {COMPOUND.format('x')})"
    out["synonym_filter_strict"] = f"WITH {LISTED}, {deduped(strict)} SELECT entry_id, array_to_string(c, ',') AS kept FROM kept"
    out["root_dedup"] = f"WITH {LISTED}, {deduped('c')} SELECT entry_id, array_to_string(c, ',') AS kept FROM kept"
    out["synonym_enhanced"] = f"WITH {LISTED}, {deduped(f'list_filter(c, lambda x: {FORM})')} SELECT entry_id, array_to_string(c[1:3], ',') AS kept FROM kept"
    out["word_roots"] = f"WITH {WORDS} SELECT word, {root('word')} AS root, {root('word', fixed.IRREGULAR_ROOTS, fixed.SHORT_ROOT_SUFFIXES, 0)} AS short_root FROM words"
    pairs = f"{LISTED}, pairs AS (SELECT DISTINCT lower(word) AS word, lower(unnest(c)) AS candidate FROM cand)"
    out["edit_similarity"] = (
        f"WITH {pairs}, r AS (SELECT *, {root('word')} AS ra, {root('candidate')} AS rb FROM pairs) SELECT word, candidate, {SIMILAR.format('word', 'candidate')} AS too_similar, "
        f"ra = rb OR (length(ra) >= 4 AND length(rb) >= 4 AND (contains(ra, rb) OR contains(rb, ra))) AS same_root, {COMPOUND.format('candidate')} AS compound FROM r"
    )
    out["high_quality_candidates"] = (
        f"WITH {pairs} SELECT word, candidate FROM pairs WHERE regexp_matches(candidate, '^[a-z]{{3,10}}$') AND NOT contains(word, candidate) AND NOT contains(candidate, word) AND candidate IN ({quoted(fixed.QUALITY_SYNONYMS)})"
    )
    out["synonym_record_stats"] = (
        "SELECT count(*) AS n_records, count(*) FILTER (WHERE len(synonyms) > 0) AS with_synonyms, count(*) FILTER (WHERE len(antonyms) > 0) AS with_antonyms, "
        "round(100.0 * count(*) FILTER (WHERE len(synonyms) > 0) / count(*), 2) AS synonym_coverage, round(avg(len(synonyms)) FILTER (WHERE len(synonyms) > 0), 4) AS avg_synonyms, "
        "round(avg(len(antonyms)) FILTER (WHERE len(antonyms) > 0), 4) AS avg_antonyms, count(*) FILTER (WHERE confidence > 0) AS successful FROM synonym_records"
    )
    out["synonym_sources"] = "SELECT source AS value, count(*) AS n FROM synonym_records GROUP BY source"
    out["synonym_latest"] = "SELECT cache_key, record_id, confidence FROM synonym_records QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, record_id DESC) = 1"
    out["synonym_keys"] = f"SELECT record_id, concat_ws(':', word, left(coalesce(context, ''), 50), coalesce(pos, '')) AS key, {pos_letter()} AS pos_letter FROM synonym_records"
    out["quality_duplicates"] = f"WITH {DUPLICATES} SELECT passage_id, word, n, unnest(ids) AS entry_id FROM dup"
    out["quality_conflicts"] = f"WITH {CONFLICTS} SELECT * FROM con"
    out["quality_meaning"] = (
        f"WITH {MEANINGS} SELECT entry_id, word, meaning_ko, problem_type, CASE WHEN problem_type IN ('missing_or_too_short', 'generic_meaning_pattern') THEN 'high' ELSE 'medium' END AS severity FROM mp WHERE problem_type IS NOT NULL"
    )
    out["quality_synonym"] = f"SELECT entry_id, word FROM workbook WHERE {MISSING}"
    out["quality_score"] = (
        f"WITH {COUNTS}, q AS (SELECT *, duplicates + conflicts + meanings + synonyms AS issues_found, round(greatest(0, 100 - ({LOST})), 1) AS quality_score FROM b) "
        "SELECT *, CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 75 THEN 'good' WHEN quality_score >= 60 THEN 'fair' ELSE 'poor' END AS band FROM q"
    )
    out["issue_counts"] = (
        f"WITH {COUNTS} SELECT 'within_passage_duplicate' AS issue_type, 'high' AS severity, duplicates AS n FROM b UNION ALL SELECT 'idiom_word_conflict', 'high', conflicts FROM b "
        "UNION ALL SELECT 'missing_synonyms', 'low', synonyms FROM b UNION ALL SELECT 'missing_korean_meaning', "
        "CASE WHEN problem_type IN ('missing_or_too_short', 'generic_meaning_pattern') THEN 'high' ELSE 'medium' END AS s, count(*) FROM mp WHERE problem_type IS NOT NULL GROUP BY s"
    )
    out["repair_conflicts"] = (
        f"WITH {CONFLICTS} SELECT entry_id, word, passage_id FROM workbook o WHERE NOT EXISTS (SELECT 1 FROM parts WHERE parts.passage_id = o.passage_id AND part = lower({strip('o.word')}) AND NOT contains(lower({strip('o.word')}), ' '))"
    )
    out["repair_duplicates"] = (
        "SELECT entry_id, word, passage_id FROM workbook QUALIFY passage_id IS NULL OR word IS NULL OR row_number() OVER (PARTITION BY passage_id, word ORDER BY coalesce(length(context), -1) DESC, entry_id) = 1"
    )
    out["repair_candidates"] = f"SELECT entry_id, word, synonyms FROM workbook WHERE ({MISSING} OR len(string_split(synonyms, ',')) < 2) AND NOT contains(word, ' ') ORDER BY entry_id LIMIT 20"
    out["clean_meanings"] = clean_meaning()
    out["confidence_buckets"] = "SELECT CASE WHEN confidence IS NULL THEN 'missing' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM workbook GROUP BY 1"
    out["match_counts"] = "SELECT match_type AS value, count(*) AS n FROM workbook GROUP BY 1"
    out["passage_entry_counts"] = (
        "SELECT passage_id, count(*) AS n_entries, count(*) FILTER (WHERE is_separated) AS n_separated, count(*) FILTER (WHERE contains(word, ' ')) AS n_idioms, "
        "count(*) FILTER (WHERE NOT contains(word, ' ')) AS n_words, count(*) FILTER (WHERE user_db_match) AS n_user FROM workbook GROUP BY 1"
    )
    out["verdict_sample"] = "SELECT entry_id, word FROM workbook WHERE meaning_ko IS NOT NULL AND context IS NOT NULL ORDER BY md5('42:' || entry_id), entry_id LIMIT 50"
    out["coercions"] = (
        f"SELECT entry_id, coalesce(is_separated, false) AS flag, coalesce(floor(try_cast({strip('passage_id')} AS DOUBLE))::BIGINT, 0) AS as_int, coalesce(try_cast({strip('word')} AS DOUBLE), -1.0) AS as_float, "
        f"len(list_filter(string_split(coalesce(synonyms, ''), ','), lambda x: length({strip('x')}) > 0)) AS n_values FROM workbook"
    )
    out["cache_latest"] = f"WITH {KV} SELECT namespace, key, value_json FROM (SELECT *, {LAST.format('')} FROM kv) WHERE nth = 1"
    out["cache_merge"] = f"WITH {KV} SELECT namespace, key, value_json FROM (SELECT *, {LAST.format('(value_json::BIGINT % 2) DESC, ')} FROM kv) WHERE nth = 1"
    out["cache_expire"] = f"WITH {KV} SELECT namespace, key, value_json FROM kv WHERE created_at >= (SELECT max(created_at) FROM kv) - INTERVAL 7 DAY"
    out["cache_stats"] = f"WITH {KV} SELECT namespace, count(*) AS n_rows, count(DISTINCT key) AS n_keys, sum(length(value_json))::BIGINT AS n_chars FROM kv GROUP BY 1"
    out["usage_cost"] = (
        "SELECT count(*) AS n_requests, sum(n_chars)::BIGINT AS prompt_tokens, sum(textbook_id)::BIGINT AS completion_tokens, round((sum(n_chars) * 0.15::DOUBLE + sum(textbook_id) * 0.6::DOUBLE) / 1000000, 6) AS cost FROM documents"
    )
    out["phrase_corpus"] = (
        f"WITH r AS (SELECT {strip('text')} AS phrase FROM documents WHERE lang = 'en'), a AS (SELECT term AS phrase, 0 AS o, 'local' AS source FROM {terms('user_idiom', 'reference_idiom')} "
        "UNION ALL SELECT phrase, 1, 'remote' FROM r WHERE length(phrase) > 0 AND len(regexp_split_to_array(phrase, '\\s+')) BETWEEN 2 AND 15) SELECT phrase, arg_min(source, o) AS source FROM a GROUP BY phrase"
    )
    wide = r"[\p{L}\p{N}_]"
    edge = r"[^\p{L}\p{N}_]"
    # every mark between words stands twice, so that each match may take one on either side
    doubled = f"d AS (SELECT row_id AS id, ' ' || regexp_replace(content, '({edge})', '\\1\\1', 'g') || ' ' AS t FROM passages WHERE content IS NOT NULL)"

    def undoubled(e: str) -> str:
        for c in (" ", r"\n", r"\t", r"\r"):
            e = f"replace({e}, E'{c}{c}', E'{c}')"
        return e

    def found(regex: str) -> str:
        return f"unnest(regexp_extract_all(t, '(?i){edge}({regex.replace(chr(92) + 'w', wide)}){edge}', 1))"

    out["known_phrases"] = f"WITH {doubled}, m AS (SELECT id, {found('(?:' + '|'.join(fixed.KNOWN_PHRASES) + ')')} AS m FROM d) SELECT id, {undoubled('m')} AS original FROM m"
    grammar = " UNION ALL ".join(f"SELECT id, '{name}' AS display_form, {found(regex)} AS m FROM d" for regex, name in fixed.GRAMMAR_PATTERNS)
    out["grammar_patterns"] = f"WITH {doubled}, m AS ({grammar}) SELECT id, display_form, {undoubled('m')} AS original FROM m"

    def listed(field: str) -> str:
        return f"list_filter(list_transform(string_split(coalesce({field}, ''), ','), lambda x: {strip('x')}), lambda x: length(x) > 0)"

    def missing(field: str) -> str:
        return f"coalesce(lower({strip(field)}) IN ('', 'nan', 'none'), true)"

    def best(field: str, name: str, most: int) -> str:
        """The enhanced lists of one field, with the number of candidates."""
        return (
            f"{name}_c AS (SELECT entry_id, word, {listed(field)} AS c FROM torefine), {name}_f AS (SELECT entry_id, word, list_filter(c, lambda x: {FORM}) AS c FROM {name}_c), "
            f"{name}_x AS (SELECT entry_id, word, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM {name}_f), {name}_r AS (SELECT *, {root('lower(c)')} AS root, {root('lower(word)')} AS own FROM {name}_x), "
            f"{name}_k AS (SELECT *, row_number() OVER (PARTITION BY entry_id, root ORDER BY i) AS nth FROM {name}_r WHERE root <> own), "
            f"{name} AS (SELECT c.entry_id, len(any_value(c.c)) AS n_api, coalesce(list(k.c ORDER BY k.i) FILTER (WHERE k.c IS NOT NULL), [])[1:{most}] AS kept FROM {name}_c c "
            f"LEFT JOIN {name}_k k ON k.entry_id = c.entry_id AND nth = 1 GROUP BY c.entry_id)"
        )

    refined = (
        f"filled AS (SELECT * FROM workbook WHERE NOT {missing('synonyms')} OR NOT {missing('antonyms')}), torefine AS (SELECT * FROM filled UNION ALL SELECT * FROM workbook WHERE NOT EXISTS (SELECT 1 FROM filled)), "
        f"{best('synonyms', 'syn', 2)}, {best('antonyms', 'ant', 1)}, "
        f"ref AS (SELECT w.entry_id, coalesce(length({strip('word')}) > 0, false) AS named, w.synonyms AS s, w.antonyms AS a, w.synonym_confidence AS c, w.process_method AS p, syn.n_api AS ns, ant.n_api AS na, syn.kept AS ks, ant.kept AS ka "
        "FROM torefine w JOIN syn USING (entry_id) JOIN ant USING (entry_id)), "
        "det AS (SELECT entry_id, CASE WHEN named THEN array_to_string(ks, ', ') ELSE s END AS synonyms, CASE WHEN named THEN array_to_string(ka, ', ') ELSE a END AS antonyms, CASE WHEN named THEN 0.3::DOUBLE ELSE c END AS synonym_confidence, "
        f"CASE WHEN named THEN '{fixed.REFINED}' ELSE p END AS process_method, coalesce(s, '') AS original_synonyms, coalesce(a, '') AS original_antonyms, "
        "CASE WHEN named THEN ns ELSE 0 END AS n_api_synonyms, CASE WHEN named THEN na ELSE 0 END AS n_api_antonyms, CASE WHEN named THEN len(ks) ELSE 0 END AS n_final_synonyms, CASE WHEN named THEN len(ka) ELSE 0 END AS n_final_antonyms, "
        "NULL::DOUBLE AS seconds, 'api_only_fallback_enhanced' AS method FROM ref)"
    )
    changed_s, changed_a = "original_synonyms <> coalesce(synonyms, '')", "original_antonyms <> coalesce(antonyms, '')"
    out["refined_workbook"] = f"WITH {refined} SELECT * FROM det"
    out["refinement_stats"] = (
        f"WITH {refined} SELECT count(*) AS n_rows, sum(n_api_synonyms)::BIGINT AS n_api_synonyms, sum(n_final_synonyms)::BIGINT AS n_final_synonyms, sum(n_api_antonyms)::BIGINT AS n_api_antonyms, sum(n_final_antonyms)::BIGINT AS n_final_antonyms, "
        "coalesce(round(sum(n_final_synonyms) * 100.0::DOUBLE / nullif(sum(n_api_synonyms), 0), 1), 0) AS synonym_adoption, coalesce(round(sum(n_final_antonyms) * 100.0::DOUBLE / nullif(sum(n_api_antonyms), 0), 1), 0) AS antonym_adoption, "
        "count(*) FILTER (WHERE coalesce(synonym_confidence, 0) >= 0.7) AS high_confidence, count(*) FILTER (WHERE coalesce(synonym_confidence, 0) >= 0.4 AND coalesce(synonym_confidence, 0) < 0.7) AS medium_confidence, "
        f"count(*) FILTER (WHERE coalesce(synonym_confidence, 0) < 0.4) AS low_confidence, count(*) FILTER (WHERE {changed_s}) AS synonyms_changed, count(*) FILTER (WHERE {changed_a}) AS antonyms_changed, "
        f"round((count(*) FILTER (WHERE {changed_s}) + count(*) FILTER (WHERE {changed_a})) * 100.0::DOUBLE / (2 * count(*)), 1) AS improvement_rate FROM det"
    )
    out["refined_comparison"] = (
        f"WITH {refined} SELECT CASE WHEN {changed_s} THEN '{fixed.CHANGED}' ELSE '{fixed.SAME}' END AS \"동의어_변화\", CASE WHEN {changed_a} THEN '{fixed.CHANGED}' ELSE '{fixed.SAME}' END AS \"반의어_변화\", "
        "process_method AS \"처리방식\", count(*) AS n FROM det GROUP BY ALL"
    )
    out["refinable_rows"] = f"WITH {refined} SELECT entry_id FROM torefine"
    rank = "coalesce(nullif(list_position(['datamuse', 'wordsapi', 'merriam'], source), 0), 4)"
    out["service_candidates"] = (
        f"WITH r AS (SELECT lower({strip('word')}) AS word, {{'rank': {rank}, 'source': source, 's': coalesce(synonyms, [])[1:20], 'a': coalesce(antonyms, [])[1:20]}} AS r FROM synonym_records WHERE word IS NOT NULL), "
        "one AS (SELECT word, min(r) AS r FROM r GROUP BY word, r.source), g AS (SELECT word, flatten(list(r.s ORDER BY r)) AS s, flatten(list(r.a ORDER BY r)) AS a FROM one GROUP BY word), "
        f"t AS (SELECT word, list_transform(s, lambda x: {strip('x')}) AS s, list_transform(a, lambda x: {strip('x')}) AS a FROM g) "
        f"SELECT word, array_to_string(list_filter(s, lambda x: {BASIC}), ',') AS api_synonyms, array_to_string(list_filter(a, lambda x: {BASIC}), ',') AS api_antonyms FROM t"
    )
    short = (fixed.IRREGULAR_ROOTS, fixed.SHORT_ROOT_SUFFIXES, 0)
    out["guarded_roots"] = f"WITH {LISTED}, {deduped('c').replace(root('lower(c)'), root('lower(c)', *short)).replace(root('lower(word)'), root('lower(word)', *short))} SELECT entry_id, array_to_string(c, ',') AS kept FROM kept"

    def single(field: str, most: int) -> str:
        return f"array_to_string(list_filter({listed(field)}, lambda x: lower(x) <> lower(word) AND length(x) > 2 AND NOT contains(x, ' '))[1:{most}], ',')"

    out["pair_filter"] = f"SELECT entry_id, {single('synonyms', 3)} AS synonyms, {single('antonyms', 2)} AS antonyms FROM workbook WHERE word IS NOT NULL"

    def text_(key: str, *values: str) -> str:
        parts = fixed.ISSUE_TEXTS[key].split("%s")
        return " || ".join(f"'{p.replace(chr(39), chr(39) * 2)}'" + (f" || coalesce({v}::VARCHAR, '')" if v else "") for p, v in zip(parts, [*values, ""]))

    said = {k: f"'{fixed.ISSUE_TEXTS[k]}'" for k in ("make_meaning", "make_synonyms")}
    columns = ("issue_type", "severity", "passage_id", "word", "idiom", "conflicting_word", "current_meaning", "problem_type", "description", "recommendation", "entry_id")
    every = [
        ("'within_passage_duplicate'", "'high'", "passage_id", "word", "NULL", "NULL", "NULL", "NULL", text_("within_passage_duplicate", "passage_id", "word", "n"), "''", "NULL", "dup"),
        ("'idiom_word_conflict'", "'high'", "passage_id", "NULL", "idiom", "word", "NULL", "NULL", text_("idiom_word_conflict", "passage_id", "idiom", "word"), text_("resolve_conflict", "idiom", "word"), "NULL", "con"),
        ("'missing_korean_meaning'", "CASE WHEN problem_type IN ('missing_or_too_short', 'generic_meaning_pattern') THEN 'high' ELSE 'medium' END", "NULL", "word", "NULL", "NULL", "meaning_ko", "problem_type",
         text_("missing_korean_meaning", "word", "meaning_ko"), said["make_meaning"], "entry_id", "mp WHERE problem_type IS NOT NULL"),
        ("'missing_synonyms'", "'low'", "NULL", "word", "NULL", "NULL", "NULL", "NULL", text_("missing_synonyms", "word"), said["make_synonyms"], "entry_id", f"workbook WHERE {MISSING}"),
    ]
    issues = "issues AS (" + " UNION ALL ".join("SELECT " + ", ".join(f"{v}::{'BIGINT' if c == 'entry_id' else 'VARCHAR'} AS {c}" for c, v in zip(columns, row)) + f" FROM {row[-1]}" for row in every) + ")"
    checks = f"WITH {DUPLICATES}, {CONFLICTS}, {MEANINGS}, {issues}"
    sheet = ", ".join((f"coalesce({c}::VARCHAR, '')" if c in columns else "''") + f' AS "{name}"' for c, name in fixed.ISSUE_COLUMNS.items())
    out["issue_sheet"] = f"{checks} SELECT {sheet} FROM issues"
    out["issue_labels"] = f"{checks} SELECT CASE issue_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.ISSUE_LABELS.items()) + " END AS label, count(*) AS n FROM issues GROUP BY 1"
    out["first_issues"] = (
        f"{checks} SELECT issue_type, passage_id, entry_id, word, conflicting_word, description FROM issues ORDER BY list_position([{quoted(fixed.ISSUE_LABELS)}], issue_type), "
        "passage_id NULLS FIRST, entry_id NULLS FIRST, word NULLS FIRST, conflicting_word NULLS FIRST LIMIT 5"
    )

    def judged(of_context: bool) -> str:
        most, need = (50, " AND context IS NOT NULL") if of_context else (30, "")
        shown = "CASE WHEN length(context) > 100 THEN left(context, 100) || '...' ELSE context END" if of_context else "NULL::VARCHAR"
        return (
            f"SELECT entry_id, passage_id, word, meaning_ko AS meaning, {shown} AS context, CASE WHEN n % 5 = 0 THEN 'medium' ELSE 'high' END AS severity, CASE WHEN n % 5 = 0 THEN '' ELSE n || ' characters' END AS analysis, "
            f"CASE WHEN n % 5 = 0 THEN '' ELSE '?' END AS suggested_meaning, '{'context' if of_context else 'accuracy'}' AS kind FROM (SELECT *, length(meaning_ko) AS n FROM workbook WHERE word IS NOT NULL AND meaning_ko IS NOT NULL{need} "
            f"ORDER BY md5('42:' || entry_id), entry_id LIMIT {most}) WHERE n % 2 = 0 AND n % 7 <> 0"
        )

    out["verdict_issues"] = f"({judged(True)}) UNION ALL ({judged(False)})"
    both = COUNTS.replace("0 AS contexts, 0 AS accuracy", f"(SELECT count(*) FROM ({judged(True)})) AS contexts, (SELECT count(*) FROM ({judged(False)})) AS accuracy")
    out["quality_score_judged"] = (
        f"WITH {both}, q AS (SELECT *, duplicates + conflicts + meanings + synonyms + contexts + accuracy AS issues_found, round(greatest(0, 100 - ({LOST})), 1) AS quality_score FROM b) "
        "SELECT *, CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 75 THEN 'good' WHEN quality_score >= 60 THEN 'fair' ELSE 'poor' END AS band FROM q"
    )
    new_lists = (
        "lists AS (SELECT lower(word) AS w, min({'s': s, 'a': a}) AS n FROM (SELECT word, "
        + ", ".join(f"array_to_string(list_filter({listed(f'array_to_string({f}, chr(44))')}, lambda x: length(x) > 1)[1:3], ', ') AS {f[0]}" for f in ("synonyms", "antonyms"))
        + " FROM synonym_records) GROUP BY 1)"
    )

    def with_lists(source: str, chosen: str) -> str:
        return (
            f"SELECT t.* EXCLUDE (synonyms, antonyms), CASE WHEN {chosen} AND length(n.s) > 0 THEN n.s ELSE synonyms END AS synonyms, CASE WHEN {chosen} AND length(n.a) > 0 THEN n.a ELSE antonyms END AS antonyms "
            f"FROM {source} t LEFT JOIN lists ON w = lower({strip('word')})"
        )

    def few(source: str) -> str:
        return f"few AS (SELECT entry_id FROM {source} WHERE ({MISSING} OR len(string_split(synonyms, ',')) < 2) AND NOT contains(word, ' ') ORDER BY entry_id LIMIT 20)"

    out["repair_synonyms"] = f"WITH {new_lists}, {few('workbook')} SELECT entry_id, synonyms, antonyms FROM ({with_lists('workbook', 'entry_id IN (SELECT entry_id FROM few)')})"
    meanings = "meanings AS (SELECT word AS mw, min(contextual_meaning) AS m FROM synonym_records WHERE contextual_meaning <> '' GROUP BY 1)"
    usable = f"meanings.m IS NOT NULL AND meanings.m <> k.word || '{fixed.GENERIC_MEANING}'"
    out["repaired_workbook"] = (
        f"WITH {new_lists}, {meanings}, {MEANINGS}, one AS (SELECT k.* EXCLUDE (meaning_ko), CASE WHEN p.problem_type IN ('generic_meaning_pattern', 'contains_english', 'missing_or_too_short') AND {usable} THEN meanings.m ELSE k.meaning_ko END AS meaning_ko "
        f"FROM workbook k JOIN mp p USING (entry_id) LEFT JOIN meanings ON mw = k.word), {few('one')}, two AS ({with_lists('one', 'entry_id IN (SELECT entry_id FROM few)')}), "
        f"rkeys AS (SELECT DISTINCT passage_id, lower({strip('word')}) AS w FROM two WHERE passage_id IS NOT NULL AND word IS NOT NULL), "
        r"rparts AS (SELECT DISTINCT passage_id, unnest(regexp_split_to_array(w, '\s+')) AS part FROM rkeys WHERE contains(w, ' ')), "
        f"three AS (SELECT * FROM two o WHERE NOT EXISTS (SELECT 1 FROM rparts WHERE rparts.passage_id = o.passage_id AND part = lower({strip('o.word')}) AND NOT contains(lower({strip('o.word')}), ' '))) "
        "SELECT entry_id, word, meaning_ko, synonyms, antonyms FROM three QUALIFY passage_id IS NULL OR word IS NULL OR row_number() OVER (PARTITION BY passage_id, word ORDER BY coalesce(length(context), -1) DESC, entry_id) = 1"
    )
    m = strip("meaning_ko")
    out["enhanced_workbook"] = (
        f"WITH {new_lists}, {meanings}, poor AS (SELECT entry_id FROM workbook WHERE meaning_ko IS NULL OR ends_with({m}, '의미') OR length({m}) < 2 ORDER BY entry_id LIMIT 25), "
        f"bare AS (SELECT entry_id FROM workbook WHERE {MISSING} ORDER BY entry_id LIMIT 25), one AS (SELECT k.* EXCLUDE (meaning_ko), CASE WHEN entry_id IN (SELECT entry_id FROM poor) AND {usable} THEN meanings.m ELSE meaning_ko END AS meaning_ko "
        f"FROM workbook k LEFT JOIN meanings ON mw = word) SELECT entry_id, word, meaning_ko, synonyms, antonyms FROM ({with_lists('one', 'entry_id IN (SELECT entry_id FROM bare)')})"
    )
    out["stream_word_counts"] = f"WITH {TOK}, w AS (SELECT unnest(ws) AS lemma FROM tok) SELECT lemma, count(*) AS n FROM w WHERE length(lemma) >= 3 GROUP BY lemma"
    out["stream_windows"] = "SELECT strftime(ingested_at, '%Y-%m-%d') AS day, count(*) AS n_passages, sum(length(content))::BIGINT AS n_chars FROM passages WHERE ingested_at IS NOT NULL GROUP BY 1"
    out["user_share"] = (
        "SELECT count(*) AS n_entries, count(*) FILTER (WHERE user_db_match) AS n_user, round(avg(coalesce(user_db_match, false)::INT) * 100, 2) AS user_share FROM workbook"
    )
    bare = strip("""regexp_replace(meaning_ko, '["'']', '', 'g')""")
    out["clean_definitions"] = (
        f"SELECT entry_id, CASE WHEN contains(word, ' ') THEN {bare} ELSE {strip(f'regexp_replace({bare}, {chr(39)}[a-zA-Z]{{3,}}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')} END AS definition FROM workbook WHERE word IS NOT NULL AND meaning_ko IS NOT NULL"
    )
    senses = "dict AS (SELECT lower(word) AS word, row_number() OVER (PARTITION BY lower(word) ORDER BY record_id) AS sense_no, contextual_meaning AS gloss, context, synonyms, antonyms FROM synonym_records)"

    def five(field: str) -> str:
        # the first of equal ones stays, in order
        flat = f"flatten(list(coalesce({field}, []) ORDER BY sense_no))"
        clean = f"list_transform({flat}, lambda x: replace(x, '_', ' '))"
        return f"{clean} AS {field[0]}"

    first = "list_filter({0}, lambda x, i: list_position({0}, x) = i AND lower(x) <> word)[1:5]"
    out["word_info"] = (
        f"WITH {WORDS}, {senses}, g AS (SELECT word, list(gloss ORDER BY sense_no)[1] AS gloss, {five('synonyms')}, {five('antonyms')} FROM dict GROUP BY word) SELECT words.word, coalesce(gloss, '') AS gloss, "
        f"coalesce(array_to_string({first.format('s').replace('<> word', '<> words.word')}, ','), '') AS synonyms, coalesce(array_to_string({first.format('a').replace('<> word', '<> words.word')}, ','), '') AS antonyms FROM words LEFT JOIN g ON g.word = words.word"
    )

    def overlap(e: str) -> str:
        return f"len(list_filter(list_intersect(list_distinct(regexp_split_to_array(lower(coalesce(meaning, '')), '\\W+')), list_distinct(regexp_split_to_array(lower(coalesce({e}, '')), '\\W+'))), lambda x: length(x) > 0))"

    out["best_senses"] = (
        f"WITH {senses}, asked AS (SELECT DISTINCT lower({strip('word')}) AS word, context AS meaning FROM workbook WHERE regexp_matches(lower({strip('word')}), '^[a-z]+$')), "
        f"sc AS (SELECT asked.word, meaning, sense_no, {overlap('gloss')} + 0.5::DOUBLE * {overlap('context')} AS score FROM asked JOIN dict USING (word)), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY word, meaning ORDER BY score DESC, sense_no) AS r, row_number() OVER (PARTITION BY word, meaning ORDER BY sense_no) AS n, max(score) OVER (PARTITION BY word, meaning) AS best FROM sc) "
        "SELECT word, meaning, sense_no, round(score, 2) AS score FROM rk WHERE CASE WHEN trim(coalesce(meaning, '')) = '' THEN n <= 2 WHEN best > 0.1 THEN r <= 2 AND score > 0.1 ELSE n = 1 END"
    )
    phonetic = (
        "0.5::DOUBLE * coalesce(list_sum(list_transform(regexp_extract_all(word, '[bcdfghjklmnpqrstvwxyz]+'), lambda r: length(r) - 1)), 0)::DOUBLE "
        f"+ 0.3::DOUBLE * ({' + '.join(f'contains(word, {chr(39)}{g}{chr(39)})::INT' for g in fixed.DIGRAPHS)})::DOUBLE"
    )
    out["difficult_words_scored"] = (
        f"WITH {WORDS}, n AS (SELECT lower(word) AS w, count(*) AS n FROM synonym_records GROUP BY 1), s AS (SELECT word, coalesce(n, 0) AS n_senses, 0.5::DOUBLE * 0.4::DOUBLE + coalesce(n, 0) * 0.1::DOUBLE * 0.3::DOUBLE + ({phonetic}) * 0.3::DOUBLE AS score FROM words LEFT JOIN n ON w = word) "
        f"SELECT word, n_senses, round(score, 4) AS score, length(word) >= 4 AND NOT {easy} AND (n_senses = 0 OR score > 0.6) AS is_difficult FROM s"
    )
    out["whitelisted"] = (
        r"""SELECT entry_id, trim(regexp_replace(regexp_replace(context, '[^\p{L}\p{N}_\s.,!?;:''"()-]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM workbook WHERE context IS NOT NULL"""
    )
    out["valid_results"] = "SELECT entry_id, word IS NOT NULL AND meaning_ko IS NOT NULL AS valid FROM workbook"
    out["difficulty_decisions"] = (
        f"WITH {WORDS}, c AS (SELECT word, CASE WHEN length(word) % 9 = 0 THEN '분석실패' WHEN ends_with(word, 's') THEN '기본어휘제외' WHEN length(word) < 7 THEN '난이도부족' WHEN contains(word, 'e') THEN '고난이도확인' ELSE 'GPT제외추천' END AS reason FROM words) "
        "SELECT word, reason = '고난이도확인' AS ok, reason FROM c"
    )
    out["separable_analysis"] = (
        f"WITH t AS (SELECT term AS idiom, string_split(term, ' ') AS p FROM {terms('user_idiom', 'reference_idiom')}) SELECT idiom, p[1] AS verb, p[2] AS particle, p[1] || ' ~ ' || p[2] AS display_form, 0.7::DOUBLE AS confidence, '' AS reason "
        "FROM t WHERE len(p) = 2 AND length(idiom) % 2 = 0"
    )
    out["cached_words"] = (
        f"WITH {WORDS}, r AS (SELECT lower(word) AS key, arg_max(cache_key, {{'t': created_at, 'v': cache_key}}) AS v FROM synonym_records GROUP BY 1) SELECT word, v AS cached FROM words LEFT JOIN r ON key = word"
    )
    out["budgeted_requests"] = f"WITH {WORDS} SELECT word AS key FROM words ORDER BY word LIMIT 500"
    out["external_lists"] = " UNION ALL ".join(f"SELECT DISTINCT unnest([{quoted(words)}]) AS term, '{name}' AS source" for name, (_, words) in fixed.EXTERNAL_LISTS.items())
    out["sense_counts"] = f"WITH {WORDS}, n AS (SELECT lower(word) AS w, count(*) AS n FROM synonym_records GROUP BY 1) SELECT word, coalesce(n, 0) AS n_senses FROM words LEFT JOIN n ON w = word"
    return out
