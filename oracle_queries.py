"""DuckDB SQL for the registered queries, written independently in long form.

Tokens are rows ``(doc_id, pos, tok)`` here, while the Spark operators keep arrays.
"""

from __future__ import annotations

from themeloom.functions import stopwords as sw
from themeloom.operators.inflection import UNINFLECTED
from themeloom.operators.lemmas import irregular_forms

_BASE = sorted(set(sw.BASE_ENGLISH))
_LEGAL = sorted(set(sw.legal_words()))
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOPIC_COUNTS = (14, 15, 16, 17, 18, 19, 20)


def _quoted(words) -> str:
    return ", ".join(f"'{word}'" for word in words)


_FILINGS = """SELECT doc_id, CASE lang
  WHEN 'en' THEN 'Cover sheet. joint  petition for a WRIT' || chr(10) || 'of certiorari No. '
    || doc_id::VARCHAR || '-12, 410 U.S. 113 ' || text
  WHEN 'fr' THEN text || ' No ' || doc_id::VARCHAR || '–7 and US 77 end'
  WHEN 'de' THEN 'JOINT PETITION FOR A WRIT OF CERTIORARI one ' || text
    || ' Joint petition for a writ of certiorari two'
  ELSE text END AS text FROM documents"""
_GAPPY = "SELECT doc_id, lang, CASE WHEN lang <> 'es' THEN text END AS text FROM documents"
_SOURCE = "SELECT doc_id, text FROM documents"


def _case_numbers(text: str) -> str:
    return rf"regexp_replace({text}, 'No\.?{_SPACE}*\d{{1,6}}(?:[-–]\d{{1,6}})?', '', 'g')"


def _cites(text: str) -> str:
    return rf"regexp_replace({text}, 'U\.?S\.?{_SPACE}*\d+', '', 'g')"


def _header(text: str) -> str:
    words = f"{_SPACE}+".join("JOINT PETITION FOR A WRIT OF CERTIORARI".split())
    return f"regexp_replace({text}, '(?si)^.*?({words})', '')"


def _boilerplate(text: str) -> str:
    return _header(_cites(_case_numbers(text)))


def _words(text: str) -> str:
    return f"string_split(lower(regexp_replace({text}, '[^A-Za-z]+', ' ', 'g')), ' ')"


def _long(relation: str, words: str, key: str = "doc_id") -> str:
    """Rows of one word each, numbered from 0."""
    return (
        f"SELECT {key}, unnest(range(len(w))) AS pos, unnest(w) AS tok "
        f"FROM (SELECT {key}, {words} AS w FROM ({relation}))"
    )


_REGULAR = """CASE
          WHEN tok LIKE '%ies' AND length(tok) > 4 THEN tok[:-4] || 'y'
          WHEN regexp_matches(tok, '(sses|shes|ches|uses|xes|oes)$') AND length(tok) > 4
            AND NOT regexp_matches(tok, '[ao]uses$')
            AND NOT regexp_matches(tok, '^(ab|acc|am|exc|f|m|ref|re|mis|conf|inf|diff)?uses$')
            AND tok NOT IN ('toes', 'shoes', 'foes', 'woes', 'canoes', 'does') THEN tok[:-3]
          WHEN tok LIKE '%s' AND tok[-2:] NOT IN ('ss', 'us', 'is') AND length(tok) > 3 THEN tok[:-2]
          ELSE tok END"""


class Chain:
    """A growing list of common table expressions over token rows."""

    def __init__(self) -> None:
        self.parts: list[str] = [f"stop AS (SELECT unnest([{_quoted(sorted({*_BASE, *_LEGAL}))}]) AS w)"]

    def add(self, name: str, sql: str) -> str:
        self.parts.append(f"{name} AS MATERIALIZED ({sql})")
        return name

    def select(self, sql: str) -> str:
        return "WITH " + ",\n".join(self.parts) + "\n" + sql

    def content(self, name: str, relation: str, key: str = "doc_id", boilerplate: bool = True) -> str:
        text = _boilerplate("text") if boilerplate else "text"
        rows = _long(relation, _words(text), key)
        return self.add(
            name,
            f"SELECT * FROM ({rows}) WHERE length(tok) BETWEEN 3 AND 15 AND tok NOT IN (SELECT w FROM stop)",
        )

    def enough(self, name: str, tokens: str, key: str = "doc_id") -> str:
        return self.add(name, f"SELECT * FROM {tokens} QUALIFY count(*) OVER (PARTITION BY {key}) >= 5")

    def lemmas(self, name: str, tokens: str, stop: str | None = "stop") -> str:
        forms = ", ".join(f"('{form}', '{lemma}')" for form, lemma in irregular_forms().items())
        rows = (
            f"SELECT * EXCLUDE (tok, form, lemma), coalesce(lemma, {_REGULAR}) AS tok FROM {tokens} "
            f"LEFT JOIN (VALUES {forms}) AS f(form, lemma) ON tok = form"
        )
        where = f" WHERE tok NOT IN (SELECT w FROM {stop})" if stop else ""
        return self.add(name, f"SELECT * FROM ({rows}){where}")

    def attested_forms(self, name: str, tokens: str) -> str:
        """Words that change, with the lemma that the tokens attest."""
        forms = ", ".join(f"('{form}', '{lemma}')" for form, lemma in irregular_forms().items())
        self.add(f"{name}_irregular", f"SELECT * FROM (VALUES {forms}) AS f(form, lemma)")
        self.add(f"{name}_voc", f"SELECT tok, count(*) AS n FROM {tokens} GROUP BY tok")
        self.add(f"{name}_tab", f"SELECT tok FROM {name}_voc WHERE tok NOT IN (SELECT form FROM {name}_irregular)")
        self._best_stems(f"{name}_singular", f"{name}_tab", f"{name}_voc", """CASE
            WHEN tok NOT LIKE '%s' OR tok[-2:] IN ('ss', 'us', 'is') THEN []
            WHEN tok LIKE '%ies' THEN [left(tok, length(tok) - 3) || 'y', left(tok, length(tok) - 1)]
            WHEN tok LIKE '%ves' THEN [left(tok, length(tok) - 1), left(tok, length(tok) - 3) || 'f', left(tok, length(tok) - 3) || 'fe']
            WHEN tok LIKE '%es' THEN [left(tok, length(tok) - 1), left(tok, length(tok) - 2)]
            ELSE [left(tok, length(tok) - 1)] END""")
        self.add(
            f"{name}_base",
            f"SELECT tok AS form, coalesce(stem, {_REGULAR}) AS tok FROM {name}_tab LEFT JOIN {name}_singular USING (tok)",
        )
        self.add(
            f"{name}_ending",
            f"""SELECT DISTINCT tok FROM {name}_base WHERE tok NOT IN ({_quoted(UNINFLECTED)})
            AND (regexp_matches(tok, '(ed|ing)$')
              OR tok LIKE '%er' AND left(tok, length(tok) - 2) || 'est' IN (SELECT tok FROM {name}_voc)
              OR tok LIKE '%est' AND left(tok, length(tok) - 3) || 'er' IN (SELECT tok FROM {name}_voc))""",
        )

        def opened(cut: int, silent: str) -> str:
            single = f"""CASE WHEN tok[length(tok) - {cut}] = tok[length(tok) - {cut + 1}]
                THEN left(tok, length(tok) - {cut + 1}) END"""
            plain = f"left(tok, length(tok) - {cut})"
            short = f"regexp_matches({plain}, '^[^aeiouy]*[aeiou][^aeiouwxy]$')"
            return f"[{silent}, CASE WHEN NOT {short} THEN {plain} END, {single}]"

        self._best_stems(f"{name}_inflected", f"{name}_ending", f"{name}_voc", f"""CASE
            WHEN tok LIKE '%ied' THEN [left(tok, length(tok) - 3) || 'y', left(tok, length(tok) - 1)]
            WHEN tok LIKE '%eed' THEN CASE WHEN length(tok) > 4 THEN [left(tok, length(tok) - 1)] ELSE [] END
            WHEN tok LIKE '%ed' THEN {opened(2, "left(tok, length(tok) - 1)")}
            WHEN tok LIKE '%ing' THEN {opened(3, "left(tok, length(tok) - 3) || 'e'")}
            WHEN tok LIKE '%iest' THEN [left(tok, length(tok) - 4) || 'y']
            WHEN tok LIKE '%est' THEN {opened(3, "left(tok, length(tok) - 2)")}
            WHEN tok LIKE '%ier' THEN [left(tok, length(tok) - 3) || 'y']
            ELSE {opened(2, "left(tok, length(tok) - 1)")} END""")
        return self.add(
            name,
            f"""SELECT form, coalesce(stem, tok) AS lemma FROM {name}_base LEFT JOIN {name}_inflected USING (tok)
            WHERE form <> coalesce(stem, tok) UNION ALL SELECT form, lemma FROM {name}_irregular""",
        )

    def _best_stems(self, name: str, words: str, vocabulary: str, stems: str) -> str:
        return self.add(
            name,
            f"""SELECT p.tok, stem FROM (
              SELECT tok, unnest(s) AS stem, generate_subscripts(s, 1) AS rank FROM (SELECT tok, {stems} AS s FROM {words})
            ) p JOIN {vocabulary} v ON v.tok = stem
            WHERE length(stem) >= 3 AND regexp_matches(stem, '[aeiouy]')
            QUALIFY row_number() OVER (PARTITION BY p.tok ORDER BY n DESC, rank) = 1""",
        )

    def attested(self, name: str, tokens: str, stop: str | None = "stop") -> str:
        """Tokens by the lemmas they attest themselves."""
        self.attested_forms(f"{name}_forms", tokens)
        rows = (
            f"SELECT t.* EXCLUDE (tok), coalesce(lemma, tok) AS tok FROM {tokens} t "
            f"LEFT JOIN {name}_forms ON tok = form"
        )
        where = f" WHERE tok NOT IN (SELECT w FROM {stop})" if stop else ""
        return self.add(name, f"SELECT * FROM ({rows}){where}")

    def phrases(self, name: str, tokens: str, min_count: int) -> str:
        """Adds <name>_scores and <name>: one learning and merging pass."""
        self.add(
            f"{name}_seq",
            f"""SELECT doc_id, pos, tok, lead(tok) OVER d AS nxt, row_number() OVER d AS seq
            FROM {tokens} WINDOW d AS (PARTITION BY doc_id ORDER BY pos)""",
        )
        self.add(f"{name}_uni", f"SELECT tok, count(*)::BIGINT AS n FROM {tokens} GROUP BY tok")
        self.add(
            f"{name}_bi",
            f"SELECT tok AS a, nxt AS b, count(*)::BIGINT AS n FROM {name}_seq WHERE nxt IS NOT NULL GROUP BY ALL",
        )
        self.add(
            f"{name}_scores",
            f"""SELECT a, b, n, score FROM (
              SELECT a, b, p.n, (p.n - {min_count}) / (ua.n::DOUBLE * ub.n::DOUBLE)
                * ((SELECT count(*) FROM {name}_uni) + (SELECT count(*) FROM {name}_bi))::DOUBLE AS score
              FROM {name}_bi p JOIN {name}_uni ua ON ua.tok = a JOIN {name}_uni ub ON ub.tok = b
              WHERE p.n >= {min_count}) WHERE score > 10""",
        )
        self.add(
            f"{name}_flag",
            f"""SELECT s.*, (p.a IS NOT NULL)::INT AS flag FROM {name}_seq s
            LEFT JOIN {name}_scores p ON p.a = s.tok AND p.b = s.nxt""",
        )
        self.add(
            f"{name}_run",
            f"SELECT *, seq - sum(flag) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM {name}_flag",
        )
        self.add(
            f"{name}_mark",
            f"""SELECT *, flag = 1 AND row_number() OVER (PARTITION BY doc_id, run, flag ORDER BY seq) % 2 = 1
              AS starts FROM {name}_run""",
        )
        return self.add(
            name,
            f"""SELECT doc_id, pos, CASE WHEN starts THEN tok || '_' || nxt ELSE tok END AS tok
            FROM (SELECT *, coalesce(lag(starts) OVER (PARTITION BY doc_id ORDER BY seq), false) AS swallowed
                  FROM {name}_mark) WHERE NOT swallowed""",
        )

    def dictionary(self, name: str, tokens: str) -> str:
        return self.add(
            name,
            f"""SELECT (row_number() OVER (ORDER BY df DESC, term) - 1)::BIGINT AS term_id, term, df, cf
            FROM (SELECT tok AS term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf
                  FROM {tokens} GROUP BY tok)
            WHERE df BETWEEN 20 AND floor(0.3::DOUBLE * (SELECT count(DISTINCT doc_id) FROM {tokens}))""",
        )

    def prepared(self, name: str) -> str:
        """The three filters of a whole run."""
        self.content("c", _SOURCE)
        self.enough("c5", "c")
        self.attested("l", "c5")
        self.enough("l5", "l")
        self.phrases("p1", "l5", 50)
        self.phrases("p2", "p1", 25)
        return self.enough(name, "p2")


_TOKENS = "string_agg(tok, ' ' ORDER BY pos) AS tokens"


def _by_doc(tokens: str, key: str = "doc_id") -> str:
    return f"SELECT {key}, {_TOKENS} FROM {tokens} GROUP BY {key}"


def _all_docs(tokens: str) -> str:
    """Documents without any token keep an empty string."""
    return (
        f"SELECT d.doc_id, coalesce(t.tokens, '') AS tokens FROM documents d "
        f"LEFT JOIN ({_by_doc(tokens)}) t USING (doc_id)"
    )


def _kept() -> Chain:
    chain = Chain()
    chain.content("c", _SOURCE)
    chain.enough("k", "c")
    return chain


def _kept_lemmas() -> Chain:
    chain = _kept()
    chain.attested("l", "k")
    chain.enough("l5", "l")
    return chain


def _text_queries() -> dict[str, str]:
    out = {
        "read_documents": "SELECT lang, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars "
        "FROM documents GROUP BY lang",
        "read_texts": "SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL",
        "row_count": "SELECT count(*)::BIGINT AS rows FROM documents",
        "preview": "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 20",
        "present_texts": f"SELECT doc_id, length(text)::BIGINT AS n_chars FROM ({_GAPPY}) WHERE text IS NOT NULL",
        "original_index": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS original_index "
        f"FROM ({_GAPPY}) WHERE text IS NOT NULL",
        "truncate_text": "SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest "
        "FROM (SELECT doc_id, substring(text, 1, 5000000) AS t FROM documents)",
        "truncate_text_binding": "SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest "
        "FROM (SELECT doc_id, substring(text, 1, 1000) AS t FROM documents)",
        "letters_only": "SELECT doc_id, md5(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g'))) AS digest "
        "FROM documents",
        "text_chunks": f"""SELECT doc_id, chunk_no, string_agg(tok, ' ' ORDER BY pos) AS text FROM (
            SELECT doc_id, pos, tok, ((row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 100)::BIGINT
              AS chunk_no
            FROM ({_long(_SOURCE, f"regexp_split_to_array(text, '{_SPACE}+')")}) WHERE tok <> '')
            GROUP BY ALL""",
    }
    for name, step in (
        ("strip_case_numbers", _case_numbers),
        ("strip_reporter_cites", _cites),
        ("strip_petition_header", _header),
    ):
        out[name] = (
            "SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest "
            f"FROM (SELECT doc_id, {step('text')} AS t FROM ({_FILINGS}))"
        )
    chain = Chain()
    chain.add(
        "w",
        f"SELECT * FROM ({_long(_SOURCE, _words('text'))}) WHERE length(tok) BETWEEN 3 AND 15",
    )
    out["word_tokens"] = chain.select(_all_docs("w"))
    chain = Chain()
    chain.content("c", _FILINGS)
    out["content_tokens"] = chain.select(_all_docs("c"))
    chain = Chain()
    chain.content("c", "SELECT conv_id, turn, text FROM conversations", "conv_id, turn")
    chain.enough("k", "c", "conv_id, turn")
    out["conversation_tokens"] = chain.select(_by_doc("k", "conv_id, turn"))
    chain = Chain()
    chain.add("w", f"SELECT * FROM ({_long(_SOURCE, _words('text'))}) WHERE length(tok) BETWEEN 1 AND 15")
    out["stop_word_use"] = chain.select(
        f"""SELECT tok AS token, tok IN ({_quoted(_BASE)}) AS is_base, tok IN ({_quoted(_LEGAL)}) AS is_legal,
        count(*)::BIGINT AS n FROM w WHERE tok IN (SELECT w FROM stop) GROUP BY ALL"""
    )
    out["enough_tokens"] = _kept().select("SELECT doc_id, count(*)::BIGINT AS n_tokens FROM k GROUP BY doc_id")
    chain = _kept()
    chain.lemmas("l", "k", stop=None)
    out["lemma_tokens"] = out["user_lemmatiser"] = chain.select(_by_doc("l"))
    chain = _kept()
    chain.attested_forms("l", "k")
    out["inflected_forms"] = chain.select("SELECT form, lemma FROM l")
    chain = _kept()
    chain.attested("l", "k", stop=None)
    out["attested_lemmas"] = chain.select(_by_doc("l"))
    out["lemma_stop_words"] = _kept_lemmas().select(_by_doc("l5"))
    chain = _kept()
    chain.lemmas("l", "k")
    out["user_function"] = chain.select(
        f"SELECT d.doc_id, coalesce(t.tokens, '') AS tokens FROM (SELECT DISTINCT doc_id FROM k) d "
        f"LEFT JOIN ({_by_doc('l')}) t USING (doc_id)"
    )
    return out


def _corpus_queries() -> dict[str, str]:
    out = {
        "aligned_documents": _kept().select(
            "SELECT d.doc_id, lang, source, count(*)::BIGINT AS n_tokens FROM documents d JOIN k USING (doc_id) "
            "GROUP BY ALL"
        ),
        "labelled_documents": _kept().select(
            "SELECT quality, toxic, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens "
            "FROM labels JOIN (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id) USING (doc_id) GROUP BY ALL"
        ),
        "alignment_report": _kept().select(
            """, a AS (SELECT DISTINCT doc_id FROM k)
            SELECT (SELECT count(*) FROM a)::BIGINT AS left_rows, (SELECT count(*) FROM labels)::BIGINT AS right_rows,
            (SELECT count(*) FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM labels))::BIGINT AS distinct_keys,
            (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS missing_right,
            (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM a))::BIGINT
              AS missing_left,
            (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1))::BIGINT
              AS repeated_keys, 0::BIGINT AS changed"""
        ),
        "alignment_changes": f"""SELECT count(*)::BIGINT AS left_rows, count(*)::BIGINT AS right_rows,
            count(DISTINCT doc_id)::BIGINT AS distinct_keys, 0::BIGINT AS missing_right, 0::BIGINT AS missing_left,
            (count(*) - count(DISTINCT doc_id))::BIGINT AS repeated_keys,
            count(*) FILTER (d.text IS DISTINCT FROM f.text)::BIGINT AS changed
            FROM documents d JOIN ({_FILINGS}) f USING (doc_id)""",
        "token_counts": _kept().select("SELECT tok AS token, count(*)::BIGINT AS n FROM k GROUP BY tok"),
        "top_tokens": _kept().select(
            "SELECT tok AS token, count(*)::BIGINT AS n FROM k GROUP BY tok ORDER BY n DESC, token LIMIT 50"
        ),
        "without_top_tokens": _kept().select(
            f""", top AS (SELECT tok FROM k GROUP BY tok ORDER BY count(*) DESC, tok LIMIT 50),
            rest AS (SELECT * FROM k WHERE tok NOT IN (SELECT tok FROM top))
            SELECT d.doc_id, coalesce(t.tokens, '') AS tokens FROM (SELECT DISTINCT doc_id FROM k) d
            LEFT JOIN ({_by_doc('rest')}) t USING (doc_id)"""
        ),
        "document_frequency": _kept().select(
            "SELECT tok AS term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM k GROUP BY tok"
        ),
        "bigram_counts": _kept().select(
            """, s AS (SELECT tok AS a, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM k)
            SELECT a, b, count(*)::BIGINT AS n FROM s WHERE b IS NOT NULL GROUP BY ALL"""
        ),
    }
    index = "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS original_index"
    chain = Chain()
    chain.content("c", f"SELECT doc_id, text FROM ({_GAPPY}) WHERE text IS NOT NULL")
    chain.enough("k", "c")
    chain.add("o", f"{index} FROM ({_GAPPY}) WHERE text IS NOT NULL")
    out["index_map"] = out["write_index_csv"] = chain.select(
        "SELECT *, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS final_index FROM o "
        "WHERE doc_id IN (SELECT doc_id FROM k)"
    )
    chain = _kept()
    chain.dictionary("d", "k")
    out["dictionary"] = chain.select("SELECT * FROM d")
    out["dictionary_keep_terms"] = chain.select("SELECT * FROM d WHERE term_id < 40")
    out["dictionary_size"] = chain.select("SELECT count(*)::BIGINT AS n_terms FROM d")
    out["bag_of_words"] = chain.select(
        "SELECT doc_id, term_id, count(*)::BIGINT AS n FROM k JOIN d ON tok = term GROUP BY ALL"
    )
    out["known_tokens"] = chain.select(
        "SELECT doc_id, count(DISTINCT tok)::BIGINT AS n_terms, count(*)::BIGINT AS n_tokens "
        "FROM k JOIN d ON tok = term GROUP BY doc_id"
    )
    out["save_corpus"] = chain.select(
        "SELECT term, cf, df, (SELECT count(*) FROM d)::BIGINT AS vocabulary FROM d"
    )
    chain = _kept()
    chain.phrases("p1", "k", 50)
    out["phrase_scores"] = chain.select("SELECT a, b, n, round(score, 6) AS score FROM p1_scores")
    out["merged_bigrams"] = chain.select(_by_doc("p1"))
    chain.phrases("p2", "p1", 25)
    out["merged_trigrams"] = chain.select(_by_doc("p2"))
    chain = Chain()
    chain.prepared("f")
    out["prepared_documents"] = chain.select(_by_doc("f"))
    counts = [("tokens", "c5"), ("lemmas", "l5"), ("phrases", "f")]
    out["stage_counts"] = chain.select(
        "SELECT 'read' AS stage, count(*)::BIGINT AS n_docs FROM documents WHERE text IS NOT NULL UNION ALL "
        + " UNION ALL ".join(
            f"SELECT '{name}', count(DISTINCT doc_id)::BIGINT FROM {tokens}" for name, tokens in counts
        )
    )
    chain.dictionary("d", "f")
    out["corpus_dictionary"] = chain.select("SELECT * FROM d")
    out["prepared_chunks"] = _chunk_query()
    return out


def _model_facts() -> dict[str, str]:
    """What is known of any model's output without training it."""
    chain = Chain()
    chain.prepared("f")
    chain.dictionary("d", "f")
    docs = "SELECT DISTINCT doc_id FROM f"
    ranges = ", ".join(f"true AS in_range_k{k}" for k in TOPIC_COUNTS)
    counts = ", ".join(map(str, TOPIC_COUNTS))
    return {
        "model_fit_facts": chain.select(
            "SELECT 14 AS k, (SELECT count(*) FROM d)::BIGINT AS vocabulary, (SELECT sum(cf) FROM d)::BIGINT AS n_tokens, "
            "true AS negative, true AS positive"
        ),
        "model_vectors_facts": chain.select(
            "SELECT doc_id, 14 AS n_topics, CASE WHEN count(term) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS total "
            "FROM f LEFT JOIN d ON tok = term GROUP BY doc_id"
        ),
        "model_words_facts": chain.select(
            """SELECT t.i::INT AS topic, (r.i + 1)::INT AS rank, true AS in_dictionary, true AS falling, 1.0::DOUBLE AS topic_total
            FROM range(14) t(i), range(10) r(i) WHERE r.i < (SELECT count(*) FROM d)"""
        ),
        "model_saved_facts": chain.select(f"SELECT doc_id, true AS same, true AS in_range FROM ({docs})"),
        "model_sweep_facts": chain.select(
            f"SELECT doc_id, lang, source, {ranges} FROM documents WHERE doc_id IN ({docs})"
        ),
        "heldout_perplexity": _heldout_query(),
        "model_evaluation_facts": chain.select(
            f"SELECT unnest([{counts}]) AS k, (SELECT count(*) FROM ({docs}))::BIGINT AS n_docs"
        ),
        "chunk_topics_facts": "SELECT count(*)::BIGINT AS n_chunks, count(*)::BIGINT AS n_in_range FROM ("
        + _chunk_query()
        + ")",
    }


def _chunk_query() -> str:
    chain = Chain()
    chain.add("chunk", _text_chunks_with_key())
    chain.content("c", "SELECT doc_id, text FROM chunk")
    chain.attested("l", "c")
    chain.enough("l5", "l")
    chain.add("stop2", "(SELECT w FROM stop) UNION (SELECT tok FROM l5 GROUP BY tok ORDER BY count(*) DESC, tok LIMIT 50)")
    chain.add(
        "again",
        "SELECT * FROM l5 WHERE length(tok) BETWEEN 3 AND 15 AND tok NOT IN (SELECT w FROM stop2)",
    )
    chain.attested("m", "again", stop="stop2")
    chain.enough("m5", "m")
    chain.phrases("p1", "m5", 50)
    chain.phrases("p2", "p1", 25)
    return chain.select(
        "SELECT doc_id // 1000000 AS doc_id, doc_id % 1000000 AS chunk_no, tokens FROM (" + _by_doc("p2") + ")"
    )


def _text_chunks_with_key() -> str:
    return f"""SELECT doc_id * 1000000 + chunk_no AS doc_id, string_agg(tok, ' ' ORDER BY pos) AS text FROM (
        SELECT doc_id, pos, tok, ((row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 100)::BIGINT
          AS chunk_no
        FROM ({_long(_SOURCE, f"regexp_split_to_array(text, '{_SPACE}+')")}) WHERE tok <> '')
        GROUP BY doc_id, chunk_no"""


_VECTORS = "SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings"
_DOMINANT = "(list_position(v, list_max(v)) - 1)::INT AS topic, list_max(v) AS prob"


def _folded(k: int) -> str:
    """Entry j of k is the sum of the entries j, j + k, j + 2k and so on."""
    return f"list_transform(range({k}), lambda j: list_reduce(v[j + 1:64:{k}], lambda a, b: a + b)) AS v"


def _assignments() -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, {_DOMINANT} FROM (SELECT doc_id, {_folded(k)} FROM ({_VECTORS}))"
        for k in TOPIC_COUNTS
    )


def _assignment_queries() -> dict[str, str]:
    columns = ", ".join(
        f"max(topic) FILTER (k = {k}) AS topic_k{k}, max(prob) FILTER (k = {k}) AS topic_k{k}_prob"
        for k in TOPIC_COUNTS
    )
    wide = (
        f"SELECT doc_id, label, w.* EXCLUDE (doc_id) FROM ({_VECTORS}) JOIN "
        f"(SELECT doc_id, {columns} FROM ({_assignments()}) GROUP BY doc_id) w USING (doc_id)"
    )
    dominant = f"SELECT doc_id, {_DOMINANT} FROM ({_VECTORS})"
    return {
        "write_assignments": _assignments(),
        "wide_assignments": wide,
        "single_assignment": f"SELECT doc_id, label, topic_k17 AS topic, topic_k17_prob AS topic_prob FROM ({wide})",
        "topic_columns": f"SELECT topic, count(*)::BIGINT AS n_docs, k FROM ({_assignments()}) GROUP BY topic, k",
        "dominant_topics": dominant,
        "sparse_topics": "SELECT * FROM (SELECT doc_id, unnest(range(len(v)))::INT AS topic, unnest(v) AS prob "
        f"FROM ({_VECTORS})) WHERE prob >= 0.01::DOUBLE",
        "topic_sizes": f"SELECT topic, count(*)::BIGINT AS n_docs FROM ({dominant}) GROUP BY topic",
        "topic_agreement": "SELECT topic_k14 AS topic_left, topic_k20 AS topic_right, count(*)::BIGINT AS n_docs "
        f"FROM ({wide}) GROUP BY ALL",
        "topic_agreement_scores": f"""WITH d AS (SELECT topic_k14 AS a, topic_k20 AS b FROM ({wide})),
            c AS (SELECT a, b, count(*)::DOUBLE AS n FROM d GROUP BY ALL),
            l AS (SELECT a, count(*)::DOUBLE AS n FROM d GROUP BY a), r AS (SELECT b, count(*)::DOUBLE AS n FROM d GROUP BY b),
            t AS (SELECT count(*)::DOUBLE AS n FROM d),
            p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS cp, (SELECT sum(n * (n - 1) / 2) FROM l) AS lp,
              (SELECT sum(n * (n - 1) / 2) FROM r) AS rp, (SELECT n * (n - 1) / 2 FROM t) AS every),
            e AS (SELECT (SELECT -sum(l.n / t.n * ln(l.n / t.n)) FROM l, t) AS hl, (SELECT -sum(l.n / t.n * ln(l.n / t.n)) FROM r l, t) AS hr,
              (SELECT sum(c.n / t.n * ln(c.n * t.n / (l.n * r.n))) FROM c JOIN l ON l.a = c.a JOIN r ON r.b = c.b CROSS JOIN t) AS mi)
            SELECT (SELECT n FROM t)::BIGINT AS n_docs,
              round((cp - lp * rp / every) / ((lp + rp) / 2 - lp * rp / every), 9) AS adjusted_rand,
              round(mi / ((hl + hr) / 2), 9) AS normalised_information FROM p, e""",
        "topic_trend_test": f"""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, topic, count(*) AS n
              FROM ({dominant}) JOIN orders ON o_orderkey = doc_id GROUP BY ALL),
            months AS (SELECT unnest(generate_series((SELECT min(period) FROM m), (SELECT max(period) FROM m), INTERVAL 1 MONTH))::DATE AS period),
            spine AS (SELECT topic, period, row_number() OVER (PARTITION BY topic ORDER BY period) AS i
              FROM (SELECT DISTINCT topic FROM m), months),
            share AS (SELECT s.topic, i, coalesce(n::DOUBLE / (SELECT sum(x.n) FROM m x WHERE x.period = s.period)::DOUBLE, 0) AS v
              FROM spine s LEFT JOIN m USING (topic, period)),
            pairs AS (SELECT a.topic, sign(b.v - a.v) AS up, (b.v - a.v) / (b.i - a.i) AS slope
              FROM share a JOIN share b ON a.topic = b.topic AND a.i < b.i),
            sums AS (SELECT topic, sum(up) AS s, median(slope) AS slope FROM pairs GROUP BY topic),
            ties AS (SELECT topic, sum(t * (t - 1) * (2 * t + 5)) AS tied, sum(t) AS n
              FROM (SELECT topic, v, count(*) AS t FROM share GROUP BY ALL) GROUP BY topic),
            z AS (SELECT topic, n, s, slope, (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - tied) / 18) AS z FROM ties JOIN sums USING (topic))
            SELECT topic, n::BIGINT AS n_periods, s::BIGINT AS s, round(z, 6) AS z,
              CASE WHEN z > 1.96 THEN 'rising' WHEN z < -1.96 THEN 'falling' ELSE 'steady' END AS direction,
              round(slope, 9) AS slope FROM z""",
        "write_wide_assignments": "SELECT doc_id, "
        + ", ".join(f"topic_k{k}, round(topic_k{k}_prob, 6) AS topic_k{k}_prob" for k in TOPIC_COUNTS)
        + f" FROM ({wide})",
        "write_topic_texts": "SELECT md5(text) AS digest, lang AS topic FROM documents WHERE text IS NOT NULL",
        "topic_trend": "SELECT date_trunc('year', o_orderdate)::DATE AS period, topic, count(*)::BIGINT AS n_docs "
        f"FROM ({dominant}) JOIN orders ON o_orderkey = doc_id GROUP BY ALL",
    }


_FLAWED = f"""SELECT doc_id, CASE WHEN label = 8 THEN list_concat(['nan'::DOUBLE], v[2:]) ELSE v END AS v,
  CASE WHEN label = 9 THEN -1 ELSE label END AS label FROM ({_VECTORS})"""
_VALID = "label >= 0 AND NOT list_bool_or(list_transform(v, lambda x: isnan(x)))"


def _metric_sql(points: str) -> str:
    """One row of three metrics; ``points`` holds doc_id, v, label."""
    return f"""WITH p AS MATERIALIZED ({points}),
    size AS (SELECT label, count(*) AS n FROM p GROUP BY label),
    gaps AS (SELECT a.doc_id, a.label AS own, b.label, sum(list_distance(a.v, b.v)) AS total
             FROM p a, p b GROUP BY ALL),
    score AS (SELECT doc_id, own,
        max(total / (n - 1)) FILTER (gaps.label = own AND n > 1) AS a,
        min(total / n) FILTER (gaps.label <> own) AS b
      FROM gaps JOIN size ON size.label = gaps.label GROUP BY ALL),
    sil AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM score),
    cells AS (SELECT label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM p),
    mean AS (SELECT label, dim, avg(x) AS c FROM cells GROUP BY ALL),
    centroid AS (SELECT label, list(c ORDER BY dim) AS c FROM mean GROUP BY label),
    spread AS (SELECT p.label, avg(list_distance(v, c)) AS s, sum(list_distance(v, c) ^ 2) AS w
               FROM p JOIN centroid USING (label) GROUP BY p.label),
    prof AS (SELECT label, c, s, w, n FROM spread JOIN centroid USING (label) JOIN size USING (label)),
    worst AS (SELECT x.label, max((x.s + y.s) / list_distance(x.c, y.c)) AS r
              FROM prof x JOIN prof y ON x.label <> y.label GROUP BY x.label),
    grand AS (SELECT list(g ORDER BY dim) AS g FROM (SELECT dim, avg(x) AS g FROM cells GROUP BY dim)),
    ch AS (SELECT sum(n * list_distance(c, g) ^ 2) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))) AS ch
           FROM prof, grand)
    SELECT (SELECT silhouette FROM sil) AS silhouette, (SELECT avg(r) FROM worst) AS davies_bouldin,
      (SELECT ch FROM ch) AS calinski_harabasz"""


def _metric_queries() -> dict[str, str]:
    every = _metric_sql(_VECTORS)
    out = {"valid_points": f"SELECT doc_id, label FROM ({_FLAWED}) WHERE {_VALID}"}
    for name in ("silhouette", "davies_bouldin", "calinski_harabasz"):
        out[name] = f"SELECT round({name}, 6) AS {name} FROM ({every})"
    # with squared distances the mean over a cluster is that to its centroid plus the cluster's variance
    out["squared_silhouette"] = f"""WITH p AS MATERIALIZED ({_VECTORS}),
    size AS (SELECT label, count(*) AS n FROM p GROUP BY label),
    gaps AS (SELECT a.doc_id, a.label AS own, b.label, sum(list_distance(a.v, b.v) ^ 2) AS total
             FROM p a, p b GROUP BY ALL),
    score AS (SELECT doc_id, own,
        max(total / (n - 1)) FILTER (gaps.label = own AND n > 1) AS a,
        min(total / n) FILTER (gaps.label <> own) AS b
      FROM gaps JOIN size ON size.label = gaps.label GROUP BY ALL)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM score"""
    # the second and fourth moment of all distances bound their mean
    out["silhouette_work"] = f"""WITH p AS MATERIALIZED (SELECT v, label, row_number() OVER () AS id, count(*) AS w
        FROM ({_VECTORS}) GROUP BY v, label),
    far AS (SELECT a.id, a.label AS own, b.label, sum(b.w * list_distance(a.v, b.v) ^ 2) / sum(b.w) AS m2,
        sum(b.w * list_distance(a.v, b.v) ^ 4) / sum(b.w) AS m4, count(*) AS targets
      FROM p a, p b GROUP BY a.id, a.label, b.label),
    dims AS (SELECT label, w, unnest(range(len(v))) AS j, unnest(v) AS x FROM p),
    middle AS (SELECT label, list(m ORDER BY j) AS c
      FROM (SELECT label, j, sum(w * x) / sum(w) AS m FROM dims GROUP BY label, j) GROUP BY label),
    bound AS (SELECT far.*, sqrt(m2) AS most,
        greatest(list_distance(p.v, c), CASE WHEN m4 > 0 THEN m2 * sqrt(m2) / sqrt(m4) ELSE 0 END) AS least
      FROM far JOIN p USING (id) JOIN middle m ON m.label = far.label),
    best AS (SELECT *, min(most) FILTER (label <> own) OVER (PARTITION BY id) AS nearest FROM bound)
    SELECT (SELECT count(*) FROM p)::BIGINT AS points, ((SELECT count(*) FROM p) ** 2)::BIGINT AS pairs_possible,
      (sum(targets) FILTER (label = own OR least <= nearest * (1 + 1e-9) + 1e-9))::BIGINT AS pairs_compared FROM best"""
    rows = []
    for k in TOPIC_COUNTS:
        cut = f"SELECT doc_id, {_folded(k)}, label FROM ({_FLAWED})"
        rows.append(f"SELECT {k} AS k, m.* FROM ({_metric_sql(f'SELECT * FROM ({cut}) WHERE {_VALID}')}) m")
    out["metric_table"] = (
        "SELECT k, round(silhouette, 4) AS silhouette, round(davies_bouldin, 4) AS davies_bouldin, "
        f"round(calinski_harabasz, 4) AS calinski_harabasz FROM ({' UNION ALL '.join(rows)})"
    )
    out["write_metric_csv"] = out["metric_table"]
    return out


def _language_terms() -> Chain:
    chain = Chain()
    rows = _long("SELECT doc_id, lang, text FROM documents", _words("text"), "doc_id, lang")
    chain.add(
        "t", f"SELECT * FROM ({rows}) WHERE length(tok) BETWEEN 3 AND 15 AND tok NOT IN (SELECT w FROM stop)"
    )
    chain.add(
        "terms",
        """SELECT lang AS topic, tok AS term,
          count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY lang))::DOUBLE AS weight
        FROM t GROUP BY lang, tok""",
    )
    chain.add(
        "ranked",
        "SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term)::INT AS rank FROM terms",
    )
    return chain


def _heldout_query() -> str:
    chain = _language_terms()
    chain.add(
        "odd",
        """SELECT lang, tok AS term, count(*) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM t) WHERE seq % 2 = 0 GROUP BY ALL""",
    )
    chain.add(
        "chances",
        """SELECT o.lang, o.term, any_value(n) AS n, sum(CASE WHEN topic = lang THEN 0.925 ELSE 0.025 END::DOUBLE * weight) AS chance
        FROM odd o JOIN terms USING (term) GROUP BY o.lang, o.term""",
    )
    return chain.select(
        """SELECT sum(n)::BIGINT AS n_tokens, round(sum(n * ln(chance)), 3) AS log_likelihood,
        round(exp(-sum(n * ln(chance)) / sum(n)), 6) AS perplexity FROM chances"""
    )


def _coherence(languages: str) -> str:
    """Window counts by listing, for every occurrence, the windows that hold it."""
    chain = _language_terms()
    chain.content("c", _SOURCE)
    chain.enough("k", "c")
    chain.add("tw", f"SELECT topic, term FROM ranked WHERE rank <= 20 AND topic IN ({languages})")
    chain.add(
        "seq",
        """SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p,
        count(*) OVER (PARTITION BY doc_id) AS len FROM k""",
    )
    chain.add("total", "SELECT sum(greatest(len - 110, 0) + 1)::DOUBLE AS t FROM (SELECT DISTINCT doc_id, len FROM seq)")
    chain.add(
        "win",
        """SELECT DISTINCT doc_id, tok, unnest(range(greatest(p - 109, 0), least(p, greatest(len - 110, 0)) + 1)) AS w
        FROM seq WHERE tok IN (SELECT term FROM tw)""",
    )
    chain.add("one", "SELECT tok, count(*)::DOUBLE AS n FROM win GROUP BY tok")
    chain.add("want", "SELECT DISTINCT a.term AS i, b.term AS j FROM tw a JOIN tw b USING (topic)")
    chain.add(
        "two",
        """SELECT i, j, count(*)::DOUBLE AS n FROM want JOIN win a ON a.tok = i
        JOIN win b ON b.tok = j AND b.doc_id = a.doc_id AND b.w = a.w GROUP BY ALL""",
    )
    chain.add(
        "npmi",
        """SELECT topic, a.term AS i, b.term AS j,
          CASE WHEN oi.n IS NULL OR oj.n IS NULL THEN 0
          ELSE ln((coalesce(two.n, 0) / t + 1e-12) / (oi.n / t * (oj.n / t))) / -ln(coalesce(two.n, 0) / t + 1e-12)
          END AS v
        FROM tw a JOIN tw b USING (topic) CROSS JOIN total LEFT JOIN one oi ON oi.tok = a.term
        LEFT JOIN one oj ON oj.tok = b.term LEFT JOIN two ON two.i = a.term AND two.j = b.term""",
    )
    chain.add("summed", "SELECT topic, j, sum(v) AS s FROM npmi GROUP BY ALL")
    chain.add(
        "cosines",
        """SELECT topic, i, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) AS c
        FROM npmi JOIN summed USING (topic, j) GROUP BY ALL""",
    )
    return chain.select("SELECT topic, avg(c) AS coherence FROM cosines GROUP BY topic")


def _browser() -> Chain:
    chain = _language_terms()
    chain.content("c", _SOURCE)
    chain.add(
        "shares",
        """SELECT lang AS topic, sum(n)::DOUBLE AS freq, sum(n)::DOUBLE / (sum(sum(n)) OVER ())::DOUBLE AS share
        FROM (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) JOIN documents USING (doc_id) GROUP BY lang""",
    )
    chain.add("wsum", "SELECT term, sum(weight) AS w FROM terms GROUP BY term")
    chain.add(
        "saliency",
        """SELECT term, freq, freq / (SELECT sum(freq) FROM shares) AS share,
          freq / (SELECT sum(freq) FROM shares) * d AS saliency
        FROM (SELECT term, sum(weight * freq) AS freq, sum(weight / w * ln(weight / w / share)) AS d
              FROM terms JOIN wsum USING (term) JOIN shares USING (topic) GROUP BY term)""",
    )
    return chain


_TOPIC_NUMBER = "(list_position(['de', 'en', 'es', 'fr'], topic) - 1)::INT AS topic"


def _word_queries() -> dict[str, str]:
    chain = _language_terms()
    browser = _browser()
    series = {2: "'de', 'en'", 3: "'de', 'en', 'es'", 4: "'de', 'en', 'es', 'fr'"}
    return {
        "top_words": chain.select(
            "SELECT topic, rank, term, round(weight, 9) AS weight FROM ranked WHERE rank <= 10"
        ),
        "write_topic_lines": chain.select(
            "SELECT 'Topic ' || topic || ': ' || string_agg(term, ', ' ORDER BY rank) AS line "
            "FROM ranked WHERE rank <= 10 GROUP BY topic"
        ),
        "topic_distances": chain.select(
            """, every AS (SELECT a.topic AS topic_a, b.topic AS topic_b, term
              FROM (SELECT DISTINCT topic FROM terms) a JOIN (SELECT DISTINCT topic FROM terms) b ON a.topic < b.topic
              CROSS JOIN (SELECT DISTINCT term FROM terms)),
            pq AS (SELECT topic_a, topic_b, coalesce(x.weight, 0) AS p, coalesce(y.weight, 0) AS q FROM every
              LEFT JOIN terms x ON x.topic = topic_a AND x.term = every.term
              LEFT JOIN terms y ON y.topic = topic_b AND y.term = every.term)
            SELECT topic_a, topic_b, round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) / 2 ELSE 0 END
              + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) / 2 ELSE 0 END), 9) AS distance FROM pq GROUP BY ALL"""
        ),
        "topic_coherence": "SELECT topic, round(coherence, 6) AS coherence FROM ("
        + _coherence("'de', 'en', 'es', 'fr'")
        + ")",
        "coherence_series": " UNION ALL ".join(
            f"SELECT {k} AS k, round(avg(coherence), 6) AS coherence FROM ({_coherence(names)})"
            for k, names in series.items()
        ),
        "topic_shares": browser.select(
            f"SELECT {_TOPIC_NUMBER}, round(freq, 6) AS freq, round(share, 9) AS share FROM shares"
        ),
        "salient_terms": browser.select(
            "SELECT term, round(freq, 6) AS freq, round(saliency, 9) AS saliency FROM saliency "
            "ORDER BY saliency.saliency DESC, term LIMIT 30"
        ),
        "relevant_terms": browser.select(
            f""", scored AS (SELECT {_TOPIC_NUMBER}, lambda_ AS "lambda", term,
              lambda_ * ln(weight) + (1 - lambda_) * (ln(weight) - ln(share)) AS relevance
              FROM terms JOIN saliency USING (term)
              CROSS JOIN (SELECT i * 0.01::DOUBLE AS lambda_ FROM range(101) t(i))),
            best AS (SELECT *, row_number() OVER (PARTITION BY topic, "lambda"
              ORDER BY round(relevance, 9) DESC, term)::INT AS rank FROM scored)
            SELECT topic, "lambda", rank, term, round(relevance, 6) AS relevance FROM best WHERE rank <= 30"""
        ),
    }


def oracle_queries() -> dict[str, str]:
    return (
        _text_queries() | _corpus_queries() | _model_facts() | _assignment_queries() | _metric_queries() | _word_queries()
    )
