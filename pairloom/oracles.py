"""The expected result of each query as SQL over the given tables (DuckDB)."""

from __future__ import annotations

from pairloom.constants import LANGUAGE_FAMILIES, MODELS, TARGET_LANGUAGES

PAIRS = """
cut AS (
  SELECT doc_id, lang, ls, unnest(range(0, (len(ls) + 1) // 2)) AS k
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents)),
texts AS (
  SELECT doc_id * 1000000 + k AS ids, ls[2 * k + 1] AS sentence,
         nullif(ls[2 * k + 2], '') AS paraphrase, lang, doc_id // 10 AS idx
  FROM cut),
pairs AS (
  SELECT *, CAST((length(sentence) + coalesce(length(paraphrase), 0)) % 7 AS INT) AS score,
         CAST(CASE WHEN (length(sentence) + coalesce(length(paraphrase), 0)) % 7 >= 4
              THEN 1 ELSE 0 END AS INT) AS quality
  FROM texts)"""

ENGLISH = PAIRS + """,
english AS (SELECT * FROM pairs WHERE lang = 'en')"""

_CODES = ", ".join(f"('{c}')" for c in TARGET_LANGUAGES)
_BACK = "CASE WHEN code IN ('es', 'ja') THEN paraphrase ELSE lower(paraphrase) END"
AUGMENTED = ENGLISH + f""",
augmented AS (
  SELECT ids, sentence, paraphrase, quality, 'en' AS lang, ids AS idx FROM english
  UNION ALL
  SELECT ids, sentence, {_BACK}, quality, code, ids
  FROM english, (VALUES {_CODES}) AS c(code))"""

PREDS = """
preds AS (
  SELECT m.model, 'docs' AS dataset, d.lang AS langs, l.doc_id AS ids, l.quality AS gold,
         CASE WHEN d.n_chars >= m.cut THEN 1 ELSE 0 END AS pred
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id,
       (VALUES ('bert', 200), ('xlnet', 500), ('roberta', 1000), ('albert', 2000)) AS m(model, cut))"""


def _counts(source: str, by: str, gold: str = "gold") -> str:
    group = f"GROUP BY {by}" if by else ""
    return f"""
  SELECT {by + ',' if by else ''}
         count(*) FILTER ({gold} = 1 AND pred = 1) AS tp, count(*) FILTER ({gold} = 0 AND pred = 1) AS fp,
         count(*) FILTER ({gold} = 1 AND pred = 0) AS fn, count(*) FILTER ({gold} = 0 AND pred = 0) AS tn
  FROM {source} {group}"""


# SQL of each metric over columns tp, fp, fn, tn.
_F1P = "CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2.0::DOUBLE*tp/(2*tp+fp+fn) END"
_F1N = "CASE WHEN 2*tn+fp+fn = 0 THEN 0 ELSE 2.0::DOUBLE*tn/(2*tn+fp+fn) END"
METRIC_SQL = {
    "accuracy": "(tp+tn)::DOUBLE/(tp+fp+fn+tn)",
    "macro_f1_score": f"""(CASE WHEN tp+fp+fn > 0 THEN {_F1P} ELSE 0 END
        + CASE WHEN tn+fp+fn > 0 THEN {_F1N} ELSE 0 END)
        / (CASE WHEN tp+fp+fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn+fp+fn > 0 THEN 1 ELSE 0 END)""",
    "weighted_f1_score": f"(({_F1P})*(tp+fn) + ({_F1N})*(tn+fp))/(tp+fp+fn+tn)",
    "f1_score": _F1P,
    "precision_score": "CASE WHEN tp+fp = 0 THEN 0 ELSE tp::DOUBLE/(tp+fp) END",
    "recall_score": "CASE WHEN tp+fn = 0 THEN 0 ELSE tp::DOUBLE/(tp+fn) END",
    "ROC-AUC": """CASE WHEN tp+fn = 0 OR tn+fp = 0 THEN NULL
        ELSE (tp::DOUBLE/(tp+fn) + tn::DOUBLE/(tn+fp))/2 END""",
}


def _metrics(by: str, names=tuple(METRIC_SQL)) -> str:
    cols = [f"round({METRIC_SQL[n]}, 6) AS {n.lower().replace('-', '_')}" for n in names]
    return ", ".join([by] * bool(by) + cols)


def _rank(key: str = "ids") -> str:
    return f"md5(concat('123:', {key}))"


def _split(source: str, names: str = "'dev'") -> str:
    return f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY {_rank()}) <= ceil(0.2 * count(*) OVER ())
      THEN {names} ELSE 'train' END AS split FROM {source}"""


def _dedup(source: str, order: str = "ids") -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY sentence, paraphrase ORDER BY {order}) AS rn FROM {source})
    WHERE rn = 1 OR lang IS NOT DISTINCT FROM 'en'"""


def _sample(source: str, n: int = 100) -> str:
    return f"""SELECT * EXCLUDE (rk) FROM (
      SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_rank()}) AS rk FROM {source})
    WHERE rk <= {n // 2}"""


PAIR = "ids AS IDS, sentence, paraphrase, quality"
CORPUS = PAIR + ", lang, idx AS index"

# Rows that augmentation stores: English ones, and translations that there are.
_FILLED = "lang = 'en' OR paraphrase IS NOT NULL"

# The augmented rows as the job stores them: each language's keys follow on.
_STORED = f"""
stored AS (SELECT * REPLACE (ids + (list_position({['en', *TARGET_LANGUAGES]}, lang) - 1)
             * (SELECT max(ids) + 1 FROM english) AS ids) FROM augmented)"""
_TWITTER = "CASE WHEN score >= 4 THEN 1 ELSE 0 END"

WORDS = """
sides AS (
  SELECT ids, quality,
         [w FOR w IN string_split_regex(lower(sentence), '[ \\t\\n\\f\\r]+') IF w <> ''] AS a,
         [w FOR w IN string_split_regex(lower(coalesce(paraphrase, '')), '[ \\t\\n\\f\\r]+') IF w <> ''] AS b
  FROM pairs),
vocab AS (
  SELECT word, n, row_number() OVER (ORDER BY n DESC, word) + 3 AS id
  FROM (SELECT word, count(*) AS n FROM (SELECT unnest(list_concat(a, b)) AS word FROM sides) GROUP BY word)
  UNION ALL
  SELECT * FROM (VALUES ('[PAD]', 0, 0), ('[UNK]', 0, 1), ('[CLS]', 0, 2), ('[SEP]', 0, 3)))"""

ENCODED = f"""WITH {PAIRS}, {WORDS},
sizes AS (SELECT ids, quality, a, b, len(a) AS la, len(b) AS lb FROM sides),
kept AS (SELECT *, least(la, greatest(63, 125 - lb)) AS ka, least(lb, greatest(62, 125 - la)) AS kb FROM sizes),
lists AS (SELECT ids, quality, la, lb, ka, kb,
          list_concat(list_concat(list_concat(['[CLS]'], a[1:ka]), list_concat(['[SEP]'], b[1:kb])), ['[SEP]']) AS ws
          FROM kept),
tokens AS (SELECT ids, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM lists),
joined AS (SELECT ids, string_agg(v.id, ',' ORDER BY pos) AS t FROM tokens JOIN vocab v USING (word) GROUP BY ids)
SELECT l.ids AS IDS, quality AS label, la, lb, CAST(ka + kb + 3 AS INT) AS n_tokens,
       t || repeat(',0', 128 - 3 - ka - kb) AS input_ids,
       '1' || repeat(',1', ka + kb + 2) || repeat(',0', 125 - ka - kb) AS attention_mask,
       '0' || repeat(',0', ka + 1) || repeat(',1', kb + 1) || repeat(',0', 125 - ka - kb) AS token_type_ids
FROM lists l JOIN joined j ON l.ids = j.ids"""

BATCHES = """
numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations)"""

_NAMES4 = ("accuracy", "f1_score", "precision_score", "recall_score")
_FAMILIES = ", ".join(f"('{c}', '{f}')" for c, _, f, _ in LANGUAGE_FAMILIES)
_GRID_SETS = [c for c, *_ in LANGUAGE_FAMILIES]
_MEMBERS = ", ".join(
    [f"('{s}', '{m}')" for s in _GRID_SETS for m in sorted({"en", s})]
    + [f"('all', '{m}')" for m in _GRID_SETS]
)
_MODELS = ", ".join(f"('{m}')" for m in MODELS)


def _stack(*parts: str) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def _numbered(source: str) -> str:
    """Rows numbered from 0 in id order, as a file scan does."""
    return f"(SELECT * REPLACE (row_number() OVER (ORDER BY ids) - 1 AS ids) FROM {source})"


def _file(lang_rule: str, extra: str = "") -> str:
    return _numbered(f"(SELECT * FROM pairs WHERE {lang_rule}{extra})")


# Lines are stripped before they are split, so a missing paraphrase takes the blanks before it along.
_STRIPPED = r"""(SELECT * REPLACE (CASE WHEN paraphrase IS NULL
  THEN nullif(regexp_replace(sentence, '\s+$', ''), '') ELSE sentence END AS sentence) FROM pairs)"""
_QUORA = """'"' || replace({0}, '"', '') || '"'"""

ORACLES: dict[str, str] = {
    "src_tsv_pairs": f"WITH {PAIRS} SELECT {PAIR} FROM {_numbered(_STRIPPED)}",
    "src_tsv_cells": f"""WITH {PAIRS} SELECT ids AS first_id, CAST(5 AS INT) AS n_cells,
        quality || '|' || ids || '|' || (ids + 1) || '|' || sentence || '|' || coalesce(paraphrase, '') AS joined
        FROM pairs""",
    "src_tsv_cells_quoted": f"""WITH {PAIRS} SELECT row_number() OVER (ORDER BY ids) - 1 AS IDS, 4::INT AS n_cells,
        sentence || '|' || coalesce(paraphrase, '') || '|(' || score || ', 6)|u' AS joined FROM pairs""",
    "read_split_csv": f"""WITH {PAIRS} SELECT ids AS IDS, nullif(sentence, '') AS sentence, paraphrase, quality
        FROM ({_split('pairs')}) WHERE split = 'dev'""",
    "prepare_tpc_downsampled": f"""WITH {PAIRS},
        clean AS (SELECT * FROM {_file("lang = 'en'")} WHERE score <> 3), s AS ({_sample('clean')}),
        test AS (SELECT *, 'test' AS split FROM {_file("lang <> 'en'")} WHERE score <> 3)
        SELECT split, {PAIR} FROM ({_stack(_split('s'), 'SELECT * FROM test')})""",
    "src_tsv_quoted": f"""WITH {PAIRS} SELECT row_number() OVER (ORDER BY ids) - 1 AS IDS,
        sentence || chr(9) || '"' || lang || '"' || chr(10) || score AS c0, paraphrase AS c1,
        '(' || score || ', 6)' AS c2, 'u' AS c3 FROM pairs""",
    "src_csv_pairs": f"WITH {PAIRS} SELECT {CORPUS} FROM pairs",
    "src_csv_renumbered": f"WITH {PAIRS} SELECT {CORPUS} FROM {_file('true')}",
    "read_split": f"""WITH {PAIRS} SELECT ids AS guid, sentence AS text_a, paraphrase AS text_b,
        quality AS label FROM ({_split('pairs')}) WHERE split = 'dev'""",
    "row_index": f"""WITH {PAIRS} SELECT row_number() OVER (ORDER BY ids) - 1 AS IDS, ids AS pair, sentence
        FROM pairs""",
    "norm_mrpc": f"WITH {PAIRS} SELECT {CORPUS} FROM pairs",
    "norm_tpc": f"""WITH {PAIRS} SELECT ids AS IDS, sentence, paraphrase, {_TWITTER} AS quality
        FROM pairs WHERE score <> 3""",
    "norm_quora": f"WITH {PAIRS} SELECT {PAIR} FROM pairs",
    "norm_quora_text": f"""WITH {PAIRS} SELECT ids AS IDS, {_QUORA.format('sentence')} AS sentence,
        {_QUORA.format("coalesce(paraphrase, 'nan')")} AS paraphrase, quality FROM pairs""",
    # The pages hold these four entities only, some cut off before the semicolon.
    "unescape_html": """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g') AS html FROM pages""",
    "filter_langs": f"WITH {PAIRS} SELECT {CORPUS} FROM pairs WHERE lang IN ('en', 'es')",
    "examples_view": f"""WITH {PAIRS} SELECT ids AS guid, sentence AS text_a, paraphrase AS text_b,
        quality AS label FROM pairs""",
    "label_check": f"""WITH {PAIRS} SELECT score AS label, score IN (0, 1) AS known, count(*) AS n_rows
        FROM pairs GROUP BY score""",
    "dedup_aug": f"WITH {PAIRS} SELECT {CORPUS} FROM ({_dedup('pairs')})",
    "dedup_by_source": f"""WITH {PAIRS}, gone AS (SELECT idx FROM (
        SELECT *, row_number() OVER (PARTITION BY sentence, paraphrase ORDER BY ids) AS rn FROM pairs)
        WHERE rn > 1 AND lang <> 'en') SELECT {CORPUS} FROM pairs WHERE idx NOT IN (SELECT idx FROM gone)""",
    "balanced_sample": f"WITH {PAIRS} SELECT {PAIR} FROM ({_sample('pairs')})",
    "downsample_siblings": f"""WITH {PAIRS}, s AS ({_sample("(SELECT * FROM pairs WHERE lang = 'en')")})
        SELECT {CORPUS} FROM s UNION ALL
        SELECT {CORPUS} FROM pairs WHERE lang <> 'en' AND idx IN (SELECT idx FROM s)""",
    "split_two": f"WITH {PAIRS} SELECT ids AS IDS, split FROM ({_split('pairs')})",
    "split_by_source": f"""WITH {PAIRS}, u AS (SELECT DISTINCT idx FROM pairs),
        r AS (SELECT idx, row_number() OVER (ORDER BY {_rank('idx')}) <= ceil(0.2 * count(*) OVER ()) AS held FROM u)
        SELECT ids AS IDS, CASE WHEN held THEN 'dev' ELSE 'train' END AS split FROM pairs JOIN r USING (idx)""",
    "split_three": f"""WITH {PAIRS}, r AS (SELECT ids, row_number() OVER (ORDER BY {_rank()}) AS rk,
        ceil(0.2 * count(*) OVER ()) AS size FROM pairs)
        SELECT ids AS IDS, CASE WHEN rk <= size THEN 'test' WHEN rk <= 2 * size THEN 'dev' ELSE 'train' END AS split
        FROM r""",
    "split_sizes": f"""WITH {PAIRS}, clean AS ({_dedup("(SELECT * FROM pairs WHERE lang IN ('en', 'es'))")})
        SELECT split, count(*) AS n_rows FROM ({_split('clean')}) GROUP BY split""",
    "augment_fanout": f"WITH {AUGMENTED} SELECT {CORPUS} FROM augmented",
    "augment_restart": f"WITH {AUGMENTED}, {_STORED} SELECT {CORPUS} FROM stored WHERE {_FILLED}",
    "augment_job_memory": f"WITH {AUGMENTED}, {_STORED} SELECT {CORPUS} FROM stored WHERE lang <> 'yo' AND ({_FILLED})",
    "augment_job_service": f"""WITH {AUGMENTED}, {_STORED} SELECT {CORPUS} FROM stored
        WHERE lang IN ('en', 'es', 'yo') AND ({_FILLED})""",
    "augment_untranslated": f"""WITH {AUGMENTED} SELECT lang, count(*) AS n_rows,
        count(*) FILTER (lang = 'yo' OR paraphrase IS NULL) AS n_missing
        FROM augmented WHERE lang <> 'en' GROUP BY lang""",
    "backtranslate_tm": f"WITH {AUGMENTED} SELECT {CORPUS} FROM augmented WHERE {_FILLED}",
    "augment_batches": f"WITH {AUGMENTED} SELECT {CORPUS} FROM augmented WHERE {_FILLED}",
    "untranslated": f"""WITH {AUGMENTED} SELECT lang, count(*) AS n_rows,
        count(*) FILTER (lang = 'yo' OR paraphrase IS NULL) AS n_missing
        FROM augmented WHERE lang <> 'en' GROUP BY lang""",
    "augment_then_dedup": f"""WITH {AUGMENTED}, numbered AS (
        SELECT * REPLACE (row_number() OVER (ORDER BY list_position({['en', *TARGET_LANGUAGES]}, lang), ids) - 1 AS ids)
        FROM augmented WHERE {_FILLED}) SELECT {CORPUS} FROM ({_dedup('numbered')})""",
    "batch_texts": f"""WITH {BATCHES} SELECT i // 50 AS batch_id, CAST(count(*) AS INT) AS n_texts,
        string_agg(text, '|' ORDER BY i) AS joined FROM numbered GROUP BY 1""",
    "flatten_batches": f"""WITH {BATCHES} SELECT i // 50 AS batch_id, CAST(i % 50 AS INT) AS pos, text
        FROM numbered""",
    "lang_sets": f"""WITH {PAIRS} SELECT lang_set, lang, count(*) AS n
        FROM pairs JOIN (VALUES {_MEMBERS}) AS m(lang_set, lang) USING (lang) GROUP BY ALL""",
    "run_grid": f"""WITH {PAIRS} SELECT d.dataset, o.model, m.lang_set, count(p.ids) AS n_rows,
        CAST(coalesce(sum(p.quality), 0) AS BIGINT) AS n_positive
        FROM (VALUES ('mrpc'), ('tpc'), ('quora')) AS d(dataset), (VALUES {_MODELS}) AS o(model),
             (VALUES {_MEMBERS}) AS m(lang_set, lang) LEFT JOIN pairs p ON p.lang = m.lang
        WHERE m.lang_set <> 'en' GROUP BY ALL""",
    "family_rollup": f"""WITH {PAIRS}, named AS (SELECT coalesce(f.family, 'other') AS family, p.lang, p.quality
        FROM pairs p LEFT JOIN (VALUES {_FAMILIES}) AS f(lang, family) ON f.lang = p.lang)
        SELECT family, lang, count(*) AS n_rows, CAST(sum(quality) AS BIGINT) AS n_positive,
               CAST(grouping(family, lang) AS INT) AS level
        FROM named GROUP BY ROLLUP (family, lang)""",
    "align_preds": f"""SELECT model, count(l.doc_id) AS n_matched, count(*) - count(l.doc_id) AS n_only_pred,
        (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_only_gold
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id, (VALUES {_MODELS}) AS o(model) GROUP BY model""",
    "argmax_preds": """SELECT doc_id, CAST(CASE WHEN n_chars / 2 > 1000 THEN CASE WHEN n_chars >= n_chars / 2 THEN 1 END
        WHEN n_chars >= 1000 THEN 1 ELSE 2 END AS INT) AS pred, CAST(n_chars AS DOUBLE) AS value FROM documents""",
    "metrics_binary": f"""WITH {PREDS}, c AS ({_counts('preds', 'model')})
        SELECT {_metrics('model', ('accuracy', 'precision_score', 'recall_score', 'f1_score', 'ROC-AUC'))} FROM c""",
    "metrics_macro": f"""WITH {PREDS}, c AS ({_counts('preds', 'model')})
        SELECT {_metrics('model', ('macro_f1_score', 'weighted_f1_score'))} FROM c""",
    "metrics_grid": f"""WITH {PREDS}, c AS ({_counts('preds', 'model, dataset, langs')})
        SELECT {_metrics('model, dataset, langs')} FROM c""",
    "results_records": f"""WITH {PREDS}, c AS ({_counts('preds', 'model, dataset, langs')})
        SELECT {_metrics('model, dataset, langs')} FROM c""",
    "mean_of_batch_means": f"""WITH {PAIRS}, b AS (SELECT avg(score) AS m FROM (
        SELECT score, (row_number() OVER (ORDER BY ids) - 1) // 32 AS b FROM pairs) GROUP BY b)
        SELECT round(avg(m), 6) AS mean_of_means, count(*) AS n_batches FROM b""",
    "leaderboard": f"""WITH {PREDS}, c AS ({_counts('preds', 'model, dataset, langs')}),
        s AS (SELECT model, dataset, m.s AS langs, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn
              FROM c JOIN (VALUES ('baseline', 'en'), ('all', 'en'), ('all', 'de'), ('all', 'es'), ('all', 'fr'),
                ('de', 'en'), ('de', 'de'), ('es', 'en'), ('es', 'es'), ('fr', 'en'), ('fr', 'fr')) AS m(s, l)
              ON m.l = c.langs GROUP BY ALL),
        r AS (SELECT model, dataset, langs, {', '.join(f'{METRIC_SQL[n]} AS {n}' for n in _NAMES4)} FROM s),
        b AS (SELECT * FROM r WHERE langs = 'baseline'),
        k AS (SELECT *, 'best' AS kind FROM r WHERE langs NOT IN ('baseline', 'all')
              QUALIFY row_number() OVER (PARTITION BY dataset, model ORDER BY accuracy DESC, langs) = 1
              UNION ALL SELECT *, langs FROM r WHERE langs IN ('baseline', 'all'))
        SELECT k.dataset, k.model, k.kind, k.langs,
               {', '.join(f'round(k.{n}, 6) AS {n}, k.{n} > b.{n} AS {n}_up' for n in _NAMES4)}
        FROM k JOIN b ON k.dataset = b.dataset AND k.model = b.model""",
    "vocab": f"WITH {PAIRS}, {WORDS} SELECT word, n, id FROM vocab",
    "encode_pairs": ENCODED,
    "encode_pairs_large_vocab": ENCODED,
    "cached_features": ENCODED,
    "score_pairs": f"""WITH {PAIRS} SELECT ids AS IDS, quality, CAST(length(sentence) AS DOUBLE) AS logit0,
        CAST(coalesce(length(paraphrase), 0) AS DOUBLE) AS logit1,
        CASE WHEN coalesce(length(paraphrase), 0) > length(sentence) THEN 1 ELSE 0 END AS pred FROM pairs""",
    "eval_split": f"""WITH {PAIRS}, p AS (SELECT quality AS gold,
        CASE WHEN coalesce(length(paraphrase), 0) > length(sentence) THEN 1 ELSE 0 END AS pred
        FROM ({_split('pairs')}) WHERE split = 'dev'), c AS ({_counts('p', '')})
        SELECT {_metrics('')} FROM c""",
    "prepare_mrpc_baseline": f"""WITH {PAIRS}, train AS (SELECT * FROM {_numbered(f"(SELECT * FROM {_STRIPPED} WHERE lang = 'en')")}),
        test AS (SELECT *, 'test' AS split FROM {_numbered(f"(SELECT * FROM {_STRIPPED} WHERE lang <> 'en')")})
        SELECT split, {PAIR} FROM ({_stack(_split('train'), 'SELECT * FROM test')})""",
    "prepare_tpc_baseline": f"""WITH {PAIRS},
        train AS (SELECT * FROM {_file("lang = 'en'")} WHERE score <> 3),
        test AS (SELECT *, 'test' AS split FROM {_file("lang <> 'en'")} WHERE score <> 3)
        SELECT split, {PAIR} FROM ({_stack(_split('train'), 'SELECT * FROM test')})""",
    "prepare_quora_baseline": f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (ORDER BY {_rank()}) AS rk,
        ceil(0.2 * count(*) OVER ()) AS size FROM pairs)
        SELECT CASE WHEN rk <= size THEN 'test' WHEN rk <= 2 * size THEN 'dev' ELSE 'train' END AS split,
        ids AS IDS, {_QUORA.format('sentence')} AS sentence,
        {_QUORA.format("coalesce(paraphrase, 'nan')")} AS paraphrase, quality FROM r""",
    "prepare_mrpc_augmented": f"""WITH {PAIRS},
        clean AS ({_dedup(f"(SELECT * FROM {_file('true')} WHERE lang IN ('en', 'es', 'de'))")}),
        s AS ({_sample("(SELECT * FROM clean WHERE lang = 'en')")}),
        chosen AS (SELECT * FROM s UNION ALL
                   SELECT * FROM clean WHERE lang <> 'en' AND idx IN (SELECT idx FROM s)),
        test AS (SELECT *, 'test' AS split FROM {_numbered(f"(SELECT * FROM {_STRIPPED} WHERE lang = 'fr')")})
        SELECT split, {PAIR} FROM ({_stack(_split('chosen'), 'SELECT * FROM test')})""",
    "prepare_tpc_augmented": f"""WITH {PAIRS},
        clean AS (SELECT *, 'train' AS split FROM ({_dedup(f"(SELECT * FROM {_file('true')} WHERE lang IN ('en', 'es'))")})),
        dev AS (SELECT *, 'dev' AS split FROM {_file("lang = 'de'")}),
        test AS (SELECT *, 'test' AS split FROM {_file("lang = 'fr'")} WHERE score <> 3)
        SELECT split, {PAIR} FROM (SELECT * FROM clean UNION ALL SELECT * FROM dev UNION ALL SELECT * FROM test)""",
    "prepare_quora_augmented": f"""WITH {PAIRS},
        clean AS (SELECT *, 'train' AS split FROM ({_dedup(f"(SELECT * FROM {_file('true')} WHERE lang IN ('en', 'es'))")})),
        dev AS (SELECT *, 'dev' AS split FROM {_file("lang = 'de'")}),
        test AS (SELECT *, 'test' AS split FROM {_file("lang = 'fr'")})
        SELECT split, {PAIR} FROM (SELECT * FROM clean UNION ALL SELECT * FROM dev UNION ALL SELECT * FROM test)""",
}


def _report_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT model, dataset, langs, '{n}' AS key, round({sql}, 6) AS value FROM c"
        for n, sql in METRIC_SQL.items()
    )
    return f"""WITH {PREDS}, c AS ({_counts('preds', 'model, dataset, langs')}), r AS ({rows})
        SELECT model, dataset, langs, key, value, key || ' = ' || coalesce(value::VARCHAR, 'nan') AS line,
               lpad(key, 20, ' ') || ': ' || coalesce(printf('%.6f', value), 'nan') AS table_line FROM r"""


def _run_sql() -> str:
    """All predictions against all labels; what has no partner or no valid value is counted."""
    numbers = {**METRIC_SQL, "n_only_pred": "n_only_pred", "n_only_gold": "n_only_gold", "n_invalid": "n_invalid"}
    rows = " UNION ALL ".join(
        f"SELECT model, '{n}' AS key, round(({sql})::DOUBLE, 6) AS value FROM c" for n, sql in numbers.items()
    )
    return f"""WITH p AS (
          SELECT m.model, doc_id, CASE WHEN n_chars >= m.cut THEN 1 ELSE 0 END AS pred FROM documents,
               (VALUES ('bert', 200), ('xlnet', 500), ('roberta', 1000), ('albert', 2000)) AS m(model, cut)),
        g AS (SELECT model, doc_id, quality FROM labels, (SELECT DISTINCT model FROM p)),
        b AS (SELECT coalesce(p.model, g.model) AS model, p.doc_id AS pid, g.doc_id AS gid, pred, quality AS gold
              FROM p FULL OUTER JOIN g ON p.model = g.model AND p.doc_id = g.doc_id),
        c AS (SELECT model, count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (gold = 0 AND pred = 1) AS fp,
                count(*) FILTER (gold = 1 AND pred = 0) AS fn, count(*) FILTER (gold = 0 AND pred = 0) AS tn,
                count(*) FILTER (gid IS NULL) AS n_only_pred, count(*) FILTER (pid IS NULL) AS n_only_gold,
                count(*) FILTER (gid IS NOT NULL AND pid IS NOT NULL AND
                  NOT coalesce(gold IN (0, 1) AND pred IN (0, 1), false)) AS n_invalid
              FROM b GROUP BY model),
        r AS ({rows})
        SELECT model, key, value, lpad(key, 20, ' ') || ': ' || coalesce(printf('%.6f', value), 'nan') AS table_line FROM r"""


def _experiment_sql() -> str:
    """For each set: filter the numbered rows by language, then drop foreign repeats."""
    sets = {"es": ["en", "es"], "ko": ["en", "ko"], "yo": ["en", "yo"], "all": ["en", *TARGET_LANGUAGES]}
    members = ", ".join(f"('{s}', '{code}')" for s, codes in sets.items() for code in codes)
    places = ", ".join(f"('{c}', {i})" for i, c in enumerate(["en", *TARGET_LANGUAGES]))
    quora = _QUORA.format("coalesce({0}, 'nan')")
    return f"""WITH {AUGMENTED},
        numbered AS (SELECT a.*, p.place FROM augmented a JOIN (VALUES {places}) AS p(lang, place) USING (lang)),
        chosen AS (SELECT m.langs, n.*, row_number() OVER (PARTITION BY m.langs, sentence, paraphrase ORDER BY place, ids) AS nr
                   FROM numbered n JOIN (VALUES {members}) AS m(langs, lang) USING (lang)),
        q AS (SELECT ids, {_QUORA.format('sentence')} AS sentence, {_QUORA.format("coalesce(paraphrase, 'nan')")} AS paraphrase, quality,
              row_number() OVER (ORDER BY {_rank()}) AS rk, ceil(0.2 * count(*) OVER ()) AS held FROM pairs),
        t AS (SELECT *, row_number() OVER (ORDER BY {_rank()}) AS rk, ceil(0.2 * count(*) OVER ()) AS held
              FROM pairs WHERE lang <> 'fr' AND score <> 3),
        train AS (
          SELECT d.dataset, langs, length(sentence) + coalesce(length(paraphrase), 0) AS size
          FROM chosen, (VALUES ('tpc'), ('quora')) AS d(dataset) WHERE lang = 'en' OR nr = 1
          UNION ALL SELECT 'quora', 'baseline', length(sentence) + length(paraphrase) FROM q WHERE rk > 2 * held
          UNION ALL SELECT 'tpc', 'baseline', length(sentence) + coalesce(length(paraphrase), 0) FROM t WHERE rk > held),
        means AS (SELECT dataset, langs, avg(size) AS mean FROM train GROUP BY dataset, langs),
        tests AS (
          SELECT 'quora' AS dataset, s.langs, length(sentence) + coalesce(length(paraphrase), 0) AS size, quality
          FROM pairs, (VALUES ('es'), ('ko'), ('yo'), ('all')) AS s(langs) WHERE lang = 'fr'
          UNION ALL SELECT 'quora', 'baseline', length(sentence) + length(paraphrase), quality FROM q WHERE rk <= held
          UNION ALL SELECT 'tpc', s.langs, length(sentence) + coalesce(length(paraphrase), 0), quality
          FROM pairs, (VALUES ('es'), ('ko'), ('yo'), ('all'), ('baseline')) AS s(langs) WHERE lang = 'fr' AND score <> 3),
        preds AS (SELECT dataset, o.model, langs, quality AS gold, CASE WHEN size >= mean * o.share THEN 1 ELSE 0 END AS pred
                  FROM tests JOIN means USING (dataset, langs), (VALUES ('bert', 1), ('albert', 2)) AS o(model, share)),
        c AS ({_counts('preds', 'model, dataset, langs')})
        SELECT {_metrics('model, dataset, langs')} FROM c"""


def _grid_sql() -> str:
    """Tables of the whole grid: each set filtered, freed from foreign repeats, sampled and split on its own."""
    places = ", ".join(f"('{c}', {i})" for i, c in enumerate(["en", *TARGET_LANGUAGES]))
    length = "length(sentence) + coalesce(length(paraphrase), 0)"
    by_set = f"row_number() OVER (PARTITION BY langs ORDER BY {_rank('nid')}) <= ceil(0.2 * count(*) OVER (PARTITION BY langs))"
    return f"""{AUGMENTED},
        numbered AS (SELECT a.*, p.place, row_number() OVER (ORDER BY p.place, ids) - 1 AS nid
                     FROM augmented a JOIN (VALUES {places}) AS p(lang, place) USING (lang)),
        sets AS (SELECT * FROM (VALUES {_MEMBERS}) AS m(langs, lang) WHERE langs <> 'en'),
        chosen AS (SELECT s.langs, n.*, row_number() OVER (PARTITION BY s.langs, sentence, paraphrase ORDER BY nid) AS nr
                   FROM numbered n JOIN sets s USING (lang)),
        kept AS (SELECT * FROM chosen WHERE lang = 'en' OR nr = 1),
        s AS (SELECT idx FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_rank('nid')}) AS rk
              FROM numbered WHERE lang = 'en') WHERE rk <= 50),
        m AS (SELECT langs, nid, {length} AS size, quality, CASE WHEN {by_set} THEN 'dev' ELSE 'train' END AS split
              FROM kept WHERE idx IN (SELECT idx FROM s)),
        b AS (SELECT 'baseline' AS langs, ids AS nid, {length} AS size, quality, split
              FROM ({_split(f"({_sample("(SELECT * FROM pairs WHERE lang <> 'fr')")})")})),
        mtest AS (SELECT langs, ids AS nid, {length} AS size, quality, 'test' AS split
                  FROM pairs, (SELECT DISTINCT langs FROM sets UNION SELECT 'baseline') WHERE lang = 'fr'),
        q AS (SELECT length({_QUORA.format('sentence')}) + length({_QUORA.format("coalesce(paraphrase, 'nan')")}) AS size, quality,
              row_number() OVER (ORDER BY {_rank()}) AS rk, ceil(0.2 * count(*) OVER ()) AS held FROM pairs),
        t AS (SELECT {length} AS size, row_number() OVER (ORDER BY {_rank()}) AS rk, ceil(0.2 * count(*) OVER ()) AS held
              FROM pairs WHERE lang <> 'fr' AND score <> 3),
        mrpc AS (SELECT * FROM m UNION ALL SELECT * FROM b UNION ALL SELECT * FROM mtest)"""


ORACLES["grid_members"] = f"""WITH {_grid_sql()}
    SELECT langs AS lang_set, split, count(*) AS n_rows, sum(quality)::BIGINT AS n_positive, sum(nid)::BIGINT AS sum_ids
    FROM mrpc GROUP BY langs, split"""
ORACLES["experiment_grid"] = f"""WITH {_grid_sql()},
    train AS (
      SELECT 'mrpc' AS dataset, langs, size FROM mrpc WHERE split = 'train'
      UNION ALL SELECT d.dataset, langs, length(sentence) + coalesce(length(paraphrase), 0)
      FROM kept, (VALUES ('tpc'), ('quora')) AS d(dataset)
      UNION ALL SELECT 'quora', 'baseline', size FROM q WHERE rk > 2 * held
      UNION ALL SELECT 'tpc', 'baseline', size FROM t WHERE rk > held),
    sums AS (SELECT dataset, langs, sum(size) AS total, count(*) AS n FROM train GROUP BY dataset, langs),
    tests AS (
      SELECT 'mrpc' AS dataset, langs, size, quality FROM mrpc WHERE split = 'test'
      UNION ALL SELECT 'quora', langs, size, quality FROM mtest WHERE langs <> 'baseline'
      UNION ALL SELECT 'quora', 'baseline', size, quality FROM q WHERE rk <= held
      UNION ALL SELECT 'tpc', langs, length(sentence) + coalesce(length(paraphrase), 0), quality
      FROM pairs, (SELECT DISTINCT langs FROM sets UNION SELECT 'baseline') WHERE lang = 'fr' AND score <> 3),
    preds AS (SELECT dataset, o.model, langs, quality AS gold, CASE WHEN size * n >= total * o.share THEN 1 ELSE 0 END AS pred
              FROM tests JOIN sums USING (dataset, langs),
              (VALUES ('bert', 1), ('xlnet', 2), ('roberta', 3), ('albert', 4)) AS o(model, share)),
    c AS ({_counts('preds', 'model, dataset, langs')})
    SELECT {_metrics('model, dataset, langs')} FROM c"""


def _words(column: str) -> str:
    return f"list_distinct([w FOR w IN string_split_regex(lower(coalesce({column}, '')), '[ \\t\\n\\f\\r]+') IF w <> ''])"


# Pairs of labelled documents with the words that both texts and only one have.
_WORD_SETS = PAIRS + f""",
ab AS (SELECT p.ids, l.quality, p.idx, {_words('p.sentence')} AS a, {_words('p.paraphrase')} AS b
       FROM pairs p JOIN labels l ON l.doc_id = p.ids // 1000000),
sets AS (SELECT ids, quality, idx, list_intersect(a, b) AS both_,
         list_concat([w FOR w IN a IF NOT list_contains(b, w)], [w FOR w IN b IF NOT list_contains(a, w)]) AS one_ FROM ab)"""

_RATIOS = _WORD_SETS + f""",
held AS (SELECT idx FROM (SELECT idx, row_number() OVER (ORDER BY {_rank('idx')}) AS rk, ceil(0.2 * count(*) OVER ()) AS n
         FROM (SELECT DISTINCT idx FROM sets)) WHERE rk <= n),
e AS (SELECT ids, quality, idx, unnest(list_concat([('both', w) FOR w IN both_], [('one', w) FOR w IN one_])) AS e FROM sets),
train AS (SELECT * FROM sets WHERE idx NOT IN (SELECT idx FROM held)),
whole AS (SELECT sum(quality)::DOUBLE AS p, (count(*) - sum(quality))::DOUBLE AS n FROM train),
counts AS (SELECT e, sum(quality) AS p, count(*) - sum(quality) AS n FROM e WHERE idx NOT IN (SELECT idx FROM held) GROUP BY e),
weights AS (SELECT e, round(ln(((counts.p + 1) / (whole.p + 2)) / ((counts.n + 1) / (whole.n + 2))) * 1000000)::BIGINT AS weight
            FROM counts, whole),
sums AS (SELECT ids, sum(weight) AS s FROM e JOIN weights USING (e) GROUP BY ids),
scored AS (SELECT ids, quality, (round(ln((whole.p + 1) / (whole.n + 1)) * 1000000) + coalesce(s, 0))::BIGINT AS score
           FROM sets LEFT JOIN sums USING (ids), whole WHERE idx IN (SELECT idx FROM held))"""

ORACLES["pair_features"] = f"""WITH {_WORD_SETS}
    SELECT ids AS IDS, quality, len(both_)::INT AS n_both, len(one_)::INT AS n_one FROM sets"""
ORACLES["fit_classifier"] = f"""WITH {_RATIOS}
    SELECT ids AS IDS, quality, score, CASE WHEN score > 0 THEN 1 ELSE 0 END AS pred FROM scored"""

def _fit_sql() -> str:
    """The iterative fit step by step: two batches in each of three epochs, rates rising once, then falling."""
    steps, batches, rate, warmup = 6, 2, 4.0, 1
    margin = "(w0 + w1 * x1 + w2 * x2)"
    parts = [f"""x AS MATERIALIZED (SELECT ids, quality, len(both_) / (len(both_) + len(one_) + 1) AS x1,
            len(one_) / (len(both_) + len(one_) + 1) AS x2, idx IN (SELECT idx FROM held) AS dev FROM sets),
        w_0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2)"""]
    for k in range(steps):
        r = rate * k / warmup if k < warmup else rate * (steps - k) / (steps - warmup)
        error = f"(1 / (1 + exp(-{margin})) - quality)"
        batch = f"('0x' || substr(md5(concat('{123 + k // batches}:', ids)), 1, 7))::BIGINT % {batches} = {k % batches}"
        parts.append(f"""w_{k + 1} AS MATERIALIZED (
          SELECT any_value(w0) - {r} * avg({error}) AS w0, any_value(w1) - {r} * avg({error} * x1) AS w1,
                 any_value(w2) - {r} * avg({error} * x2) AS w2 FROM x, w_{k} WHERE NOT dev AND {batch})""")
    scored = " UNION ALL ".join(
        f"SELECT {k} AS step, ids, quality, {margin} AS m FROM x, w_{k} WHERE dev" for k in range(batches, steps + 1, batches)
    )
    loss = "greatest(m, 0) + ln(exp(-greatest(m, 0)) + exp(m - greatest(m, 0))) - CASE WHEN quality = 1 THEN m ELSE 0 END"
    return f"""{_WORD_SETS},
        held AS (SELECT idx FROM (SELECT idx, row_number() OVER (ORDER BY {_rank('idx')}) AS rk, ceil(0.2 * count(*) OVER ()) AS n
                 FROM (SELECT DISTINCT idx FROM sets)) WHERE rk <= n),
        {', '.join(parts)},
        s AS (SELECT *, quality AS gold, CASE WHEN m > 0 THEN 1 ELSE 0 END AS pred, {loss} AS loss FROM ({scored})),
        c AS ({_counts('s', 'step')}),
        l AS (SELECT step, avg(loss) AS loss FROM s GROUP BY step)"""


ORACLES["fit_epochs"] = f"""WITH {_fit_sql()}
    SELECT step, (step // 2)::INT AS epoch, round(loss, 6) AS dev_loss, {_metrics('')} FROM c JOIN l USING (step)"""
ORACLES["fit_best_state"] = f"""WITH {_fit_sql()}
    SELECT ids AS IDS, step::INT AS step, quality, pred FROM s
    WHERE step = (SELECT step FROM c ORDER BY {_F1P} DESC, step LIMIT 1)"""
ORACLES["eval_loss"] = f"""WITH {PAIRS}, n AS (
    SELECT row_number() OVER (ORDER BY ids) - 1 AS i, quality, length(sentence)::DOUBLE AS a,
           coalesce(length(paraphrase), 0)::DOUBLE AS b FROM pairs),
    l AS (SELECT i // 32 AS k, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b)))
            - CASE WHEN quality = 1 THEN b ELSE a END AS loss FROM n)
    SELECT round(avg(m), 6) AS eval_loss, count(*) AS n_batches FROM (SELECT k, avg(loss) AS m FROM l GROUP BY k)"""
_TAGGED = """(SELECT row_number() OVER (ORDER BY ids) - 1 AS IDS, sentence, paraphrase, quality,
    CASE WHEN ids % 97 = 0 THEN 'label' WHEN paraphrase IS NULL THEN 'paraphrase' END AS reason,
    CASE WHEN ids % 97 = 0 THEN 'n/a ' ELSE '' END || quality || chr(9) || ids || chr(9) || (ids + 1) || chr(9)
      || sentence || chr(9) || coalesce(paraphrase, '') AS line FROM pairs)"""
ORACLES["src_tsv_rejects"] = f"WITH {PAIRS} SELECT IDS, reason, line FROM {_TAGGED} WHERE reason IS NOT NULL"
ORACLES["src_tsv_checked"] = f"WITH {PAIRS} SELECT IDS, sentence, paraphrase, quality FROM {_TAGGED} WHERE reason IS NULL"
ORACLES["augment_job_answers"] = ORACLES["augment_job_service"]
ORACLES["answers_reused"] = f"""WITH {ENGLISH},
    t AS (SELECT paraphrase, CASE WHEN bool_or(ids % 10 <> 0) THEN 1 ELSE 2 END AS run FROM english
          WHERE paraphrase IS NOT NULL GROUP BY paraphrase)
    SELECT run::INT AS run, lang, to_foreign, count(*) AS n_asked
    FROM t, (VALUES ('es'), ('yo')) AS l(lang), (VALUES (true), (false)) AS d(to_foreign) GROUP BY ALL"""
ORACLES["report_file"] = f"""SELECT row_number() OVER (ORDER BY model, dataset, langs, key) - 1 AS place, table_line AS line
    FROM ({_report_sql()})"""
_NAMED = ", ".join(f"('{c}', '{n}', '{f}', '{b}')" for c, n, f, b in LANGUAGE_FAMILIES)
ORACLES["family_metrics"] = f"""WITH {PREDS},
    n AS (SELECT model, gold, pred, coalesce(family, 'other') AS family, coalesce(branch, 'other') AS branch,
            coalesce(language, langs) AS language
          FROM preds LEFT JOIN (VALUES {_NAMED}) AS f(lang, language, family, branch) ON f.lang = langs),
    c AS (SELECT model, family, branch, language, grouping(family, branch, language)::INT AS level,
            count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (gold = 0 AND pred = 1) AS fp,
            count(*) FILTER (gold = 1 AND pred = 0) AS fn, count(*) FILTER (gold = 0 AND pred = 0) AS tn
          FROM n GROUP BY GROUPING SETS ((model, family, branch, language), (model, family, branch), (model, family), (model)))
    SELECT {_metrics('model, family, branch, language, level')} FROM c"""
ORACLES["score_pairs_cached"] = f"""WITH {PAIRS} SELECT ids AS IDS, quality, CAST(length(sentence) AS DOUBLE) AS logit0,
    coalesce(length(paraphrase), 0) / 2 AS logit1,
    CASE WHEN coalesce(length(paraphrase), 0) / 2 > length(sentence) THEN 1 ELSE 0 END AS pred FROM pairs"""
ORACLES["src_tsv_quoted_parallel"] = ORACLES["src_tsv_quoted"]
ORACLES["src_csv_parallel"] = f"""WITH {PAIRS} SELECT row_number() OVER (ORDER BY ids) - 1 AS IDS,
    sentence || chr(10) || '",' || lang || '"' AS sentence, paraphrase, quality, lang, idx AS index FROM pairs"""
ORACLES["downsample_siblings_joined"] = ORACLES["downsample_siblings"]
ORACLES["metrics_report"] = _report_sql()
ORACLES["evaluate_run"] = _run_sql()
ORACLES["experiment_runs"] = _experiment_sql()
