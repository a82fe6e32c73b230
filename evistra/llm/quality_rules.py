"""Line-first quality rules with DataFrame and SQL functions only.

Each line is held against punctuation, navigation and boilerplate rules; lines that fail are removed, and a
document that loses too much of its text this way is rejected. Everything is worked out inside the row, so there
is no shuffle, and each step costs a document's words once (a sort for the repeated windows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistra.llm._common import WORD

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Opening phrases of boilerplate lines in English, German, French and Spanish, lower case.
BOILERPLATE = (
    "all rights reserved", "copyright", "licensed under", "this work is licensed", "terms of use", "privacy policy",
    "cookie policy", "subscribe to", "sign up for", "click here", "read more", "share this",
    "alle rechte vorbehalten", "impressum", "datenschutz", "nutzungsbedingungen", "cookie-richtlinie", "jetzt abonnieren",
    "jetzt anmelden", "hier klicken", "weiterlesen", "mehr lesen", "artikel teilen",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "politique de cookies", "abonnez-vous",
    "inscrivez-vous", "cliquez ici", "lire la suite", "partager cet article",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "términos de uso", "política de cookies",
    "suscríbete", "regístrate", "haz clic", "haga clic", "leer más", "compartir este artículo",
)
#: Words that only separate the entries of a navigation line, and what may end a sentence.
SEPARATORS, TERMINAL = "|>›»·•/", ".!?…:;\"'”’»)。！？"
#: A line fails with more symbols than words times this, with this share of its words ending in a run of ! or ?,
#: with this share of separators among its words, or with so many words and no end of a sentence. A document is rejected
#: below this share of its characters kept.
MAX_SYMBOLS, MAX_SHOUTED, MAX_BARS, MIN_SENTENCE, MIN_KEPT = 0.5, 0.5, 0.2, 5, 0.3


def measured(docs: DataFrame) -> DataFrame:
    """docs with the base measures, base_failed, kept and clean_text.

    A null text is empty: no words, base_failed. Empty lines never fail a rule. Repeated rows are judged alike; whole
    texts are read, however long. An empty table gives no rows.
    """
    w = "regexp_extract_all(_text, '" + WORD.replace("\\", "\\\\") + "', 0)"
    d = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    d = d.withColumn("_words", F.expr(w))
    # lines: words, characters of words, symbols, shouted words, bare separators
    d = d.withColumn("_lines", F.split("_text", "\n"))
    worded = F.filter("_lines", lambda x: F.trim(F.translate(x, SPACES, " ")) != "")
    d = d.withColumn("_worded", worded)
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.translate("_text", SPACES, "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"))
    d = d.withColumn("_hash", F.transform("_words", lambda x: F.xxhash64(x)))
    cols = ", ".join(f"slice(_hash, {i + 1}, greatest(size(_hash) - {WINDOW - 1}, 0))" for i in range(WINDOW))
    names = ", ".join(f"t['{i}']" for i in range(WINDOW))
    d = d.withColumn("_windows", F.expr(f"transform(arrays_zip({cols}), t -> xxhash64({names}))"))
    repeats = f"""
      if(size(array_distinct(_windows)) = size(_windows), 0L,
        element_at(transform(array(sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i)))),
          s -> element_at(transform(array(sort_array(transform(filter(
              transform(s, (x, k) -> named_struct('i', x.i, 'twice', (k > 0 and get(s, k - 1).h = x.h) or coalesce(get(s, k + 1).h = x.h, false))),
              y -> y.twice), y -> y.i))),
            p -> aggregate(p, named_struct('n', 0L, 'end', 0),
              (a, i) -> named_struct('n', a.n + least({WINDOW}, i + {WINDOW} - a.end), 'end', i + {WINDOW}), a -> a.n)), 1)), 1))"""
    d = d.withColumn("n_repeat_words", F.expr(repeats))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    size = lambda x: F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))
    count = lambda x, p: F.size(F.regexp_extract_all(x, F.lit(p), F.lit(0)))
    opening = "^(?iu:" + "|".join(BOILERPLATE) + ")"

    def good(x):
        n = size(x)
        symbols = F.length(x) - F.length(F.translate(x, SYMBOLS, ""))
        shouted = count(x, r"[!?]{2,}(?=[\x20\x09-\x0D]|$)")
        bars = F.when(x.rlike(f"[{SEPARATORS}]"), count(x, rf"(?<![^\x20\x09-\x0D])[{SEPARATORS}](?![^\x20\x09-\x0D])")).otherwise(0)
        ended = F.instr(F.lit(TERMINAL), F.right(F.rtrim(F.translate(x, SPACES, " " * len(SPACES))), F.lit(1))) > 0
        punctuation = (symbols > n * F.lit(MAX_SYMBOLS)) | (shouted > n * F.lit(MAX_SHOUTED)) | ((n >= MIN_SENTENCE) & ~ended)
        return (n == 0) | ~(punctuation | (bars > n * F.lit(MAX_BARS)) | F.ltrim(x).rlike(opening))

    d = d.withColumn("clean_text", F.array_join(F.filter("_lines", good), "\n"))
    left = F.length(F.translate("clean_text", SPACES, ""))
    d = d.withColumn("kept", ~F.col("base_failed") & (left >= F.col("word_chars") * F.lit(MIN_KEPT)))
    return d.drop("_text", "_words", "_lines", "_worded", "_hash", "_windows")


def rules_report(docs: DataFrame) -> DataFrame:
    """The measures and verdict of every document, without its text."""
    return measured(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
