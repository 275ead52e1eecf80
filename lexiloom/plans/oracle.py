"""The queries once more, as DuckDB SQL on the same tables. Written from what they mean, not from how they run here."""

from __future__ import annotations

GAP = "[\\s\\x0B\\p{Zs}]+"
CORPUS = "corpus AS (SELECT doc_id, lang AS label, text FROM documents WHERE text <> '')"


def trim(text: str = "text") -> str:
    return f"regexp_replace({text}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def clean(text: str = "text") -> str:
    return f"regexp_replace({trim(text)}, '{GAP}', ' ', 'g')"


def words(text: str = "text") -> str:
    return f"regexp_split_to_array({trim(text)}, '{GAP}')"


def chars(text: str = "text") -> str:
    return f"(list_filter(string_split({trim(text)}, ''), lambda c: c <> ''))[2:]"


def ngrams(tokens: str, high: int) -> str:
    """List of all runs of 1 to high tokens; tokens names a list column."""
    parts = [tokens]
    for o in range(2, high + 1):
        joined = " || '-' || ".join(f"{tokens}[i + {k}]" for k in range(o))
        parts.append(f"list_transform(range(1, greatest(len({tokens}) - {o - 2}, 1)), lambda i: {joined})")
    return "flatten([" + ", ".join(parts) + "])"


def shown(text: str, where: str = CORPUS) -> str:
    return f"WITH {where} SELECT doc_id, length(t) AS n_chars, md5(t) AS md5 FROM (SELECT doc_id, {text} AS t FROM corpus)"


def tokens_shown(tokens: str) -> str:
    return f"WITH {CORPUS} SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS md5 FROM (SELECT doc_id, {tokens} AS t FROM corpus)"


def replaced(pattern: str, to: str, text: str = "text") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({text}, '{quoted}', '{to}', 'g')"


def counts(source: str, name: str, char_order: int = 3) -> str:
    """Tables {name}f (doc_id, label, feature) and {name} (doc_id, label, feature, cnt) of a table with text."""
    return f"""{name}t AS (SELECT doc_id, label, {chars(clean())} AS c, {words(clean())} AS w FROM {source}),
    {name}f AS (SELECT doc_id, label, unnest(list_concat({ngrams('c', char_order)}, w)) AS feature FROM {name}t),
    {name} AS (SELECT doc_id, label, feature, count(*) AS cnt FROM {name}f GROUP BY ALL)"""


def dictionary(counted: str, name: str) -> str:
    return f"""{name}c AS (SELECT feature, sum(cnt)::BIGINT AS cnt FROM {counted} GROUP BY feature),
    {name}k AS (SELECT feature, cnt FROM {name}c WHERE cnt >= 2 AND feature <> '--unk--' UNION ALL SELECT '--unk--', count(*) FILTER (cnt < 2) FROM {name}c),
    {name} AS (SELECT feature, (row_number() OVER (ORDER BY feature) - 1)::INTEGER AS idx, cnt, cnt / sum(cnt) OVER () AS p FROM {name}k)"""


def vectors(counted: str, entries: str, name: str, multiplier: str = "sqrt(1 / p)") -> str:
    return f"""{name}i AS (SELECT c.doc_id, coalesce(d.idx, u.idx) AS idx, sum(c.cnt) AS cnt, any_value(coalesce(d.p, u.p)) AS p
        FROM {counted} c LEFT JOIN {entries} d USING (feature), (SELECT idx, p FROM {entries} WHERE feature = '--unk--') u GROUP BY ALL),
    {name} AS (SELECT doc_id, idx, cnt / sum(cnt) OVER (PARTITION BY doc_id) * {multiplier} AS val FROM {name}i)"""


def summary(table: str, places: int = 6) -> str:
    return f"SELECT doc_id, count(val) AS n, round(sum(val), {places}) AS total, round(max(val), {places}) AS most FROM {table} GROUP BY doc_id"


FULL = f"{CORPUS}, {counts('corpus', 'fc')}, {dictionary('fc', 'dict')}"
UNIGRAM = f"{CORPUS}, {counts('corpus', 'fc', 1)}, {dictionary('fc', 'dict')}, {vectors('fc', 'dict', 'vec', '1')}"


def split(share: float) -> str:
    """Table parts: corpus with is_test."""
    cut = f"floor(n::FLOAT * {share}::FLOAT + 0.5::FLOAT)" if share > 0 else f"floor(n::FLOAT * {1 + share}::FLOAT + 0.5::FLOAT)"
    test = f"place <= {cut}" if share > 0 else f"place > {cut}"
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM corpus),
    parts AS (SELECT doc_id, label, text, {test} AS is_test FROM placed)"""


SPLIT = f"{CORPUS}, {split(0.1)}, train AS (SELECT * FROM parts WHERE NOT is_test), test AS (SELECT * FROM parts WHERE is_test), {counts('train', 'tc')}, {dictionary('tc', 'dict')}, {counts('test', 'sc')}"
SCORES = f"""{SPLIT}, {vectors('tc', 'dict', 'tv')}, {vectors('sc', 'dict', 'sv')},
    sizes AS (SELECT label, count(*) AS n FROM train GROUP BY label),
    weights AS (SELECT label, idx, sum(val) / any_value(n) AS weight FROM tv JOIN train USING (doc_id) JOIN sizes USING (label) GROUP BY label, idx),
    dots AS (SELECT doc_id, label, sum(val * weight) AS score FROM sv JOIN weights USING (idx) GROUP BY ALL),
    scores AS (SELECT d.doc_id, s.label, coalesce(score, 0) AS score FROM (SELECT DISTINCT doc_id FROM sv) d CROSS JOIN sizes s LEFT JOIN dots USING (doc_id, label)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label)::INTEGER AS rank, 100 * exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM scores),
    sure AS (SELECT doc_id, label, score, rank, e / sum(e) OVER (PARTITION BY doc_id) * 100 AS confidence FROM ranked),
    outputs AS (SELECT t.doc_id, t.label AS truth, s.label AS output FROM test t JOIN sure s ON t.doc_id = s.doc_id AND rank = 1)"""
SOURCES = "corpus AS (SELECT doc_id, source AS label, text FROM documents WHERE text <> ''), least AS (SELECT count(*) // count(DISTINCT label) AS m FROM corpus)"
EMBEDDED = "emb AS (SELECT vec_id AS doc_id, unnest(range(len(embedding)))::INTEGER AS idx, unnest(embedding)::DOUBLE AS val FROM embeddings)"


def top(features: str) -> str:
    return f"""WITH {CORPUS}, t AS (SELECT label, {chars(clean())} AS c, {words(clean())} AS w FROM corpus),
    f AS (SELECT label, unnest({features}) AS feature FROM t), n AS (SELECT label, feature, count(*) AS cnt FROM f GROUP BY ALL)
    SELECT label, (row_number() OVER (PARTITION BY label ORDER BY cnt DESC, feature))::INTEGER AS rank, feature, cnt FROM n
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY cnt DESC, feature) <= 20"""


def segments() -> str:
    """Tables t (the corpus' tokens in order, with their neighbours over all lines, and whether they are boundaries) and stats."""
    mark, piece = "([.]+|[。۔…?!])", '[^\\s\\x0B\\x{85}\\p{Z},;"]+'
    plain = "translate(text, '’‘`“”', '" + "''" * 3 + '""' + "')"
    parts = f"list_transform(regexp_extract_all({plain}, '{piece}'), lambda x: CASE WHEN regexp_full_match(x, '.+?{mark}') AND NOT regexp_full_match(x, '{mark}') THEN [regexp_extract(x, '^(.+?){mark}$', 1), regexp_extract(x, '^(.+?){mark}$', 2)] ELSE [x] END)"
    return f"""{CORPUS}, tk AS (SELECT doc_id, flatten({parts}) AS ws FROM corpus),
        t0 AS (SELECT doc_id, unnest(range(len(ws))) AS spot, unnest(ws) AS word FROM tk),
        t1 AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY spot) AS follows FROM t0),
        t AS (SELECT word, regexp_full_match(word, '{mark}') AS mark, coalesce(lag(word) OVER o, '<s>') AS prev, coalesce(lead(word) OVER o, '<s>') AS after FROM t1
            WHERE follows IS DISTINCT FROM word OR NOT regexp_full_match(word, '[.!?]+') WINDOW o AS (ORDER BY doc_id, spot)),
        stats AS (SELECT 'N' AS stat, '' AS a, '' AS b, count(*) AS n FROM t HAVING count(*) > 0 UNION ALL SELECT 'cA', word, '', count(*) FROM t GROUP BY word UNION ALL SELECT 'cAB', prev, '', count(*) FROM t WHERE mark GROUP BY prev
            UNION ALL SELECT 'cPN', prev, after, count(*) FROM t WHERE mark GROUP BY prev, after UNION ALL SELECT 'cB', '', '', count(*) FROM t WHERE mark HAVING count(*) > 0)"""


def abbreviations() -> str:
    log = "CASE WHEN {0} >= 1e-20 THEN ln({0}) ELSE -5000 END".format
    llr = f"2 * (ab * ln(0.99) + (w - ab) * ln(1 - 0.99) - ab * ({log('p')}) - (w - ab) * ({log('(1 - p)')}))"
    return f"""WITH {segments()}, x AS (SELECT s.a AS word, s.n::DOUBLE AS ab, c.n::DOUBLE AS w, (SELECT n FROM stats WHERE stat = 'cB')::DOUBLE / (SELECT n FROM stats WHERE stat = 'N') AS p
        FROM stats s JOIN stats c ON s.a = c.a AND s.stat = 'cAB' AND c.stat = 'cA')
        SELECT word, round(({llr}) * CASE WHEN regexp_full_match(word, '([.]+|[。۔…?!])') THEN 2 ELSE 1 END * exp(-(length(word) + 1)) * pow(length(word)::DOUBLE, ab - w), 6) + 0.0 AS score FROM x"""


ORACLE: dict[str, str] = {
    "segmenter_counts": f"WITH {segments()} SELECT stat, count(*) AS n_entries, sum(n)::BIGINT AS total, max(n) AS most FROM stats GROUP BY stat",
    "abbr_llr": abbreviations(),
    "clean_space": shown(clean()),
    "lower_case": shown("lower(text)"),
    "regex_replace": shown(replaced("[aeiou]+", "_")),
    "decontract": shown(replaced("'d\\b", " would", replaced("'re\\b", " are", replaced("n't\\b", " not", replaced("'ll\\b", " will", replaced("'s\\b", " is")))))),
    "normalize_urls": shown(replaced("(?:ftp|ssh|https?)|://[^\\s\\x0B]+", "+URL+")),
    "normalize_currency": shown(replaced("\\p{Sc}\\d+(,\\d+)*\\.?(\\d+)?", "+CURRENCY+")),
    "normalize_date": shown(replaced("\\b\\d+/\\d+/\\d+\\b", "+DATE+")),
    "normalize_time": shown(replaced("\\b\\d+:\\d+(:\\d+)?\\b", "+TIME+")),
    "normalize_numbers": shown(replaced("\\b\\d+(,\\d+)*(\\.\\d+)*(?:st|nd|rd|th|s|%)?\\b", "+NUMBER+")),
    "normalize_abbreviations": shown(replaced("([A-Z]\\.)[\\s\\x0B]*([A-Z]\\.)", "\\1\\2")),
    "normalize_punctuation": shown(replaced("\\p{Pe}", ")", replaced("\\p{Ps}", "(", replaced("\\p{Pi}|\\p{Pf}", '"', replaced("\\p{Pd}", "-", replaced("[\\x{2026}\\x{22ee}\\x{fe19}]", "...")))))),
    "strip_trailing_quote": shown("regexp_replace(text || '\"', '\"$', '')"),
    "word_tokens": tokens_shown(words()),
    "char_tokens": tokens_shown(chars()),
    "ideograph_tokens": tokens_shown(f"flatten(list_transform(regexp_split_to_array({trim()}, '[\\s\\x0B]+'), lambda w: CASE WHEN regexp_full_match(w, '[A-Za-z0-9]+') THEN [w] ELSE (string_split(w, ''))[2:] END))"),
    "tokenize_tr": tokens_shown("regexp_split_to_array(replace(replace(text, '-', ' '), '''', ' '' '), '[\\s\\x0B]+')"),
    "parse_labelled_lines": """SELECT doc_id, 0::INTEGER AS form, lang AS label, length(text) AS n_chars FROM documents WHERE text <> ''
        UNION ALL SELECT doc_id, 1, lang, length(regexp_replace(text, '[\\n\\r]+', ' ', 'g')) FROM documents WHERE text <> ''""",
    "rejected_lines": "SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang",
    "char_ngrams_top": top(ngrams("c", 3)),
    "word_ngrams_top": top(ngrams("w", 2)),
    "wc_features_top": top(f"list_concat({ngrams('c', 3)}, w)"),
    "doc_feature_counts": f"""WITH {CORPUS}, {counts('corpus', 'fc')} SELECT doc_id, count(*) AS n_distinct, sum(cnt)::BIGINT AS n_all,
        arg_min(feature, (-cnt, feature)) AS top_feature, max(cnt) AS top_cnt FROM fc GROUP BY doc_id""",
    "feature_dictionary": f"WITH {FULL} SELECT feature, idx, cnt FROM dict",
    "background_model": f"WITH {FULL} SELECT idx, round(p, 12) AS p FROM dict",
    "tfllr_vectors": f"WITH {FULL}, {vectors('fc', 'dict', 'vec')} {summary('vec')}",
    "tflog_vectors": f"WITH {FULL}, {vectors('fc', 'dict', 'vec', 'ln(1 / p)')} {summary('vec')}",
    "zbkg_stats": f"""WITH {UNIGRAM}, n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM vec)
        SELECT idx, round(sum(val) / any_value(n), 9) AS mean, round(sqrt(greatest(sum(val * val) / any_value(n) - pow(sum(val) / any_value(n), 2), 0)), 6) AS std FROM vec, n GROUP BY idx""",
    "znorm_vectors": f"""WITH {UNIGRAM}, n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM vec),
        bg AS (SELECT idx, sum(val) / any_value(n) AS mean, sqrt(greatest(sum(val * val) / any_value(n) - pow(sum(val) / any_value(n), 2), 0)) AS std FROM vec, n GROUP BY idx),
        z AS (SELECT doc_id, idx, (val - mean) / std AS val FROM vec JOIN bg USING (idx) WHERE std > 1e-9) {summary('z', 3)}""",
    "oov_to_unk": f"""WITH {SPLIT}, u AS (SELECT idx FROM dict WHERE feature = '--unk--'), f AS (SELECT s.doc_id, s.cnt, coalesce(d.idx, u.idx) = u.idx AS is_u FROM sc s LEFT JOIN dict d USING (feature), u)
        SELECT doc_id, coalesce(sum(cnt) FILTER (is_u), 0)::BIGINT AS n_unknown, coalesce(sum(cnt) FILTER (NOT is_u), 0)::BIGINT AS n_known FROM f GROUP BY doc_id""",
    "known_features": f"WITH {SPLIT} SELECT doc_id, count(*) AS n_entries, sum(s.cnt)::BIGINT AS n_known FROM sc s JOIN dict USING (feature) GROUP BY doc_id",
    "merge_vectors": f"WITH {EMBEDDED}, b AS (SELECT * FROM emb UNION ALL SELECT doc_id, idx + 64, val * 2 FROM emb) SELECT doc_id, count(*) AS n, max(idx) AS top_idx, round(sum(val), 6) AS total FROM b GROUP BY doc_id",
    "threshold_vectors": f"WITH {EMBEDDED}, t AS (SELECT doc_id, idx, CASE WHEN val < 0.05 THEN 0 ELSE val END AS val FROM emb) {summary('t')}",
    "vector_totals": f"WITH {EMBEDDED} SELECT doc_id, round(sum(val), 6) AS total, round(sum(val * val), 6) AS normp FROM emb GROUP BY doc_id",
    "sparse_dot": f"""WITH {EMBEDDED}, m AS (SELECT e.label, idx, avg(val) AS w FROM emb JOIN embeddings e ON e.vec_id = doc_id GROUP BY ALL)
        SELECT doc_id, label, round(sum(val * w), 6) AS dot FROM emb JOIN m USING (idx) GROUP BY doc_id, label""",
    "split_fv": f"""WITH {CORPUS}, p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS spot, count(*) OVER () AS n FROM corpus)
        SELECT (spot // floor(n / 7 + 0.5)::BIGINT)::INTEGER AS set_id, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM p GROUP BY 1""",
    "light_vector_roundtrip": f"WITH {EMBEDDED} SELECT doc_id, count(*) AS n, round(sum(val), 6) AS total FROM emb GROUP BY doc_id",
    "dataset_breakdown": f"WITH {CORPUS} SELECT label, count(*) AS n FROM corpus GROUP BY label UNION ALL SELECT 'Total', count(*) FROM corpus",
    "drop_small_classes": f"WITH {SOURCES} SELECT doc_id, label FROM corpus, least QUALIFY count(*) OVER (PARTITION BY label) >= m",
    "dropped_labels": f"WITH {SOURCES} SELECT label FROM corpus GROUP BY label HAVING count(*) < (SELECT m FROM least)",
    "stratify": f"WITH {CORPUS}, c AS (SELECT count(*) AS n FROM corpus GROUP BY label) SELECT doc_id, label FROM corpus QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) <= (SELECT min(n) FROM c)",
    "train_test_split": f"WITH {CORPUS}, {split(0.15)} SELECT doc_id, label, is_test FROM parts",
    "split_from_end": f"WITH {CORPUS}, {split(-0.2)} SELECT doc_id, label, is_test FROM parts",
    "filter_label": f"WITH {CORPUS} SELECT label, count(*) AS n FROM corpus WHERE label IS DISTINCT FROM 'fr' GROUP BY label",
    "id_label_join": """SELECT d.doc_id, l.label, length(d.text) AS n_chars FROM (SELECT doc_id, arg_max(text, doc_id) AS text FROM documents GROUP BY doc_id) d
        JOIN (SELECT doc_id, arg_max(quality::VARCHAR, toxic) AS label FROM labels GROUP BY doc_id) l USING (doc_id)""",
    "distinct_labels": f"WITH {CORPUS} SELECT DISTINCT label FROM corpus",
    "linear_score": f"WITH {SCORES} SELECT doc_id, label, round(score, 6) AS score FROM scores",
    "rank_scores": f"WITH {SCORES} SELECT doc_id, label, rank FROM ranked",
    "top_n": f"WITH {SCORES} SELECT doc_id, label, rank, round(confidence, 4) AS confidence FROM sure WHERE rank <= 2",
    "softmax_confidence": f"WITH {SCORES} SELECT doc_id, label, round(confidence, 4) AS confidence FROM sure",
    "confusion_matrix": f"WITH {SCORES} SELECT truth, output, count(*) AS n FROM outputs GROUP BY ALL",
    "class_accuracy": f"WITH {SCORES} SELECT truth, count(*) AS n, round(avg((truth = output)::INTEGER), 6) AS accuracy FROM outputs GROUP BY truth",
    "overall_accuracy": f"WITH {SCORES} SELECT count(*) AS n, count(*) FILTER (truth = output) AS correct, round(avg((truth = output)::INTEGER), 6) AS accuracy FROM outputs",
    "least_accurate5": f"WITH {SCORES} SELECT truth, count(*) AS n, round(avg((truth = output)::INTEGER), 6) AS accuracy FROM outputs GROUP BY truth ORDER BY avg((truth = output)::INTEGER), truth LIMIT 5",
    "regression_mse": """WITH e AS (SELECT label, pow(embedding[1]::DOUBLE - label, 2) AS e FROM embeddings) SELECT label::VARCHAR AS label, count(*) AS n, round(avg(e), 6) AS mse FROM e GROUP BY label
        UNION ALL SELECT 'all', count(*), round(avg(e), 6) FROM e""",
    "union_results": f"""WITH {CORPUS} SELECT label, 'words' AS kind, sum(len({words()}))::BIGINT AS n FROM corpus GROUP BY label UNION ALL SELECT label, 'chars', sum(len({chars()}))::BIGINT FROM corpus GROUP BY label""",
    "word_class_translate": f"""WITH {CORPUS}, w AS (SELECT DISTINCT unnest({words()}) AS word FROM corpus), k AS (SELECT word, upper(word[1]) AS class, log10(0.5) AS l FROM w WHERE regexp_full_match(word, '[a-z]{{1,3}}')),
        i AS (SELECT item_id AS doc_id, list_filter(regexp_split_to_array({trim()}, '[\\s\\x0B]+'), lambda x: x <> '') AS ws FROM benchmark),
        p AS (SELECT doc_id, unnest(range(len(ws))) AS spot, unnest(ws) AS word FROM i), j AS (SELECT doc_id, spot, coalesce(class, '<unk>') AS class, coalesce(l, 0) AS l FROM p LEFT JOIN k USING (word))
        SELECT doc_id, md5(string_agg(class, ' ' ORDER BY spot)) AS md5, round(sum(l), 6) AS logp FROM j GROUP BY doc_id""",
    "lm_backoff_score": f"""WITH {CORPUS}, t AS (SELECT list_concat(['<s>'], list_filter(regexp_split_to_array(trim(text, ' '), '[\\s\\x0B]+'), lambda x: x <> ''), ['</s>']) AS s FROM corpus),
        g AS (SELECT unnest(list_transform(range(1, len(s)), lambda i: s[i])) AS c, unnest(list_transform(range(1, len(s)), lambda i: s[i + 1])) AS w FROM t),
        uni AS (SELECT w, log10((count(*) - 0.5) / sum(count(*)) OVER ()) AS p FROM g GROUP BY w), ctx AS (SELECT c, count(*) AS n, count(DISTINCT w) AS k FROM g GROUP BY c),
        bi AS (SELECT c, w, log10((count(*) - 0.5) / any_value(n)) AS p FROM g JOIN ctx USING (c) GROUP BY c, w), bo AS (SELECT c, log10(k * 0.5 / n) AS b FROM ctx),
        ends AS (SELECT c FROM bo WHERE c NOT IN (SELECT w FROM uni)),
        it AS (SELECT item_id AS doc_id, list_concat(['<s>'], list_filter(regexp_split_to_array(trim(text, ' '), '[\\s\\x0B]+'), lambda x: x <> ''), ['</s>']) AS s FROM benchmark),
        q AS (SELECT doc_id, unnest(list_transform(range(1, len(s)), lambda i: s[i])) AS c, unnest(list_transform(range(1, len(s)), lambda i: s[i + 1])) AS w FROM it)
        SELECT doc_id, round(sum(coalesce(bi.p, uni.p + coalesce(bo.b, 0), CASE WHEN q.w IN (SELECT c FROM ends) THEN -99 + coalesce(bo.b, 0) END, 0)), 4) AS logp
        FROM q LEFT JOIN bi USING (c, w) LEFT JOIN uni USING (w) LEFT JOIN bo ON bo.c = q.c GROUP BY doc_id""",
    "stage_dag": f"""WITH {CORPUS}, tidy AS (SELECT label, {clean()} AS t FROM corpus), twice AS (SELECT * FROM tidy UNION ALL SELECT * FROM tidy WHERE length(t) > 500)
        SELECT label, count(*) AS n, sum(length(t))::BIGINT AS n_chars FROM twice GROUP BY label""",
}
