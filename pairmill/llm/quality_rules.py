"""Line-first quality rules, in native expressions only.

Every line is judged on its own (punctuation, navigation, boilerplate, symbol noise);
failing lines are removed; then documents that lose too large a share of their text, or
that fail the word-level base rules, are rejected. All of it is row-local: one scan, no
shuffle, no Python, so a skewed source or a group of copies costs nothing extra.

Defined cases. Null text counts as the empty text: all counts 0, rejected. Empty and
blank lines never fail and are never duplicates. Repeated rows are judged row by row. No
rows: no rows. Very long texts are judged whole.
Other columns of the input, whatever their names, pass through `clean` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns valid in both Java's and RE2's syntax; phrases in English, German, French
# and Spanish, letters outside ASCII in both cases.
SPACE = "[ \\t-\\r]+"
SYMBOL = "[#*$%&|<>]"
TERMINAL = "[.!?…:;][\"')\\]»”’]*[ \\t-\\r]*$"
FIVE_WORDS = "([^ \\t-\\r]+[ \\t-\\r]+){4}[^ \\t-\\r]"
NAVIGATION = (
    "(?i)^[ \\t-\\r]*(home|main menu|menu|log ?in|sign ?(in|up)|register|search|next( page)?|previous( page)?"
    "|skip to (main )?content|back to top|share( this)?|read more|site ?map|contact us|about us"
    "|startseite|(haupt)?men[üÜ]|anmelden|registrieren|suchen?|weiter(lesen)?|zur[üÜ]ck|nach oben|teilen|mehr lesen|impressum|kontakt|[üÜ]ber uns"
    "|accueil|menu principal|connexion|s'inscrire|rechercher|suivante?|pr[éÉ]c[éÉ]dente?|haut de page|partager|lire la suite|plan du site|contact|[àÀ] propos"
    "|inicio|men[úÚ]( principal)?|iniciar sesi[óÓ]n|registrarse|buscar|siguiente|anterior|volver arriba|compartir|leer m[áÁ]s|mapa del sitio|contacto|sobre nosotros)"
    "[ \\t-\\r]*[>»|:]*[ \\t-\\r]*$"
)
BOILERPLATE = (
    "(?i)(privacy policy|cookie policy|we use cookies|accept (all )?cookies|terms of (use|service)"
    "|all rights reserved|enable javascript|click here|subscribe to our newsletter|lorem ipsum|powered by wordpress"
    "|datenschutzerkl[äÄ]rung|wir verwenden cookies|cookies akzeptieren|nutzungsbedingungen|alle rechte vorbehalten|javascript aktivieren|hier klicken|newsletter abonnieren"
    "|politique de confidentialit[éÉ]|nous utilisons des cookies|accepter (tous )?les cookies|conditions d'utilisation|tous droits r[éÉ]serv[éÉ]s|activez javascript|cliquez ici|abonnez-vous"
    "|pol[íÍ]tica de (privacidad|cookies)|utilizamos cookies|aceptar (todas )?las cookies|(t[éÉ]rminos|condiciones) de uso|todos los derechos reservados|habilite javascript|haga clic aqu[íÍ]|suscr[íÍ]bete)"
)
NOT_EMPTY = "[^ \\t-\\r]"

#: Words a document needs; share (%) of its words in repeated 8-word windows that rejects it.
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8
#: Share (%) of its characters that a document may lose with its failing lines.
MAX_LOST_PCT = 40
#: Boilerplate is only removed in lines up to this length: a long paragraph that names a policy is prose.
BOILERPLATE_CHARS = 300


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def line_fails(line: Column) -> Column:
    """True for a line that any of the per-line rules removes."""
    length = F.length(line)
    symbols = F.regexp_count(line, F.lit(SYMBOL))
    pipes = F.regexp_count(line, F.lit("[|»›•]"))
    return line.rlike(NOT_EMPTY) & (
        (~line.rlike(TERMINAL) & ~line.rlike(FIVE_WORDS))
        | line.rlike(NAVIGATION)
        | ((pipes >= 2) & (pipes * 60 >= length))
        | ((symbols >= 3) & (symbols * 12 >= length))
        | ((length <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE))
    )


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more. Sorted (hash, start)
    pairs put equal windows side by side; each start then adds the words up to the next
    start, WINDOW at most. n log n in the number of windows."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(pairs, lambda s: _let(starts(s), total))


def measures(text: Column) -> Column:
    """Struct of the base counts, the cleaned text and the verdict for one text."""

    def of_text(t: Column) -> Column:
        lines = F.split(t, "\n")
        full = F.filter(lines, lambda x: x.rlike(NOT_EMPTY))
        # transform(sequence) over no window is empty: sequence(1, 0) would count down
        windows = lambda w: F.when(
            F.size(w) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>"))
        repeats = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long"))
        base = _let(
            words_of(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _let(windows(w), repeats).alias("n_repeat_words"),
            ),
        )
        dup_lines = _let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        kept_lines = F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n")
        return F.struct(
            base.alias("base"),
            F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            dup_lines.alias("n_dup_lines"),
            kept_lines.alias("clean"),
            F.length(t).cast("long").alias("n_chars"),
        )

    return _let(F.coalesce(text, F.lit("")), of_text)


def _verdict(m: Column) -> tuple[Column, Column]:
    base = m["base"]
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PCT * base["n_words"])
    lost = 100 * (m["n_chars"] - F.length(m["clean"])) > MAX_LOST_PCT * m["n_chars"]
    return failed, ~failed & ~lost


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, base_failed, kept and the text left by the line rules."""
    m = F.col("m")
    failed, kept = _verdict(m)
    return docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m")).select(
        "doc_id",
        m["base"]["n_words"].alias("n_words"),
        m["base"]["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"),
        m["base"]["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        kept.alias("kept"),
        m["clean"].alias("clean_text"),
    )


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines; all other columns stay."""
    # an array of one or no measures, exploded: a plain filter would be pushed below the
    # projection and work the measures out again for the verdict and for the text
    kept = F.filter(F.array(measures(F.col(text_col))), lambda m: _verdict(m)[1])
    return (
        docs.withColumn("__quality_m", F.explode(kept))
        .withColumn(text_col, F.col("__quality_m")["clean"])
        .drop("__quality_m")
    )
