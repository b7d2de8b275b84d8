"""Column expressions for text: tokens, lines, folding, markup and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of French, German, Italian and Spanish and what they fold to.
ACCENTED = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def words(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once, though it is used often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_counts(text: Column) -> Column:
    """Structs (term, n) of a text's words, each once: equal words stand together when sorted, so nothing leaves the row."""

    def runs(w: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return _let(begins, lambda at: F.transform(at, lambda p, j: F.struct(F.get(w, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(w)) - p).cast("long").alias("n"))))

    none = F.array().cast("array<struct<term:string,n:bigint>>")
    return _let(F.array_sort(words(text)), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(none))


def lines(text: Column) -> Column:
    """Lines of a text; a passage's number is its place from 1."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def sentences(text: Column) -> Column:
    """Sentences of a line that has no breaks: split after a full stop, question or exclamation mark and white space."""
    return F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+", -1)


def folded(text: Column) -> Column:
    """Lower-cased, with accents folded."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def slug(text: Column) -> Column:
    """For file names: folded, other signs as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.replace(folded(text), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def source_path(provider: Column, title: Column, external_id: Column, lang: Column) -> Column:
    """Where a source's file stands: a folder for each provider, then slug, provider, id and language."""
    return F.concat_ws("/", F.lit("sources"), provider, F.concat(F.concat_ws("_", slug(title), provider, external_id, lang), F.lit(".md")))


def html_title(page: Column) -> Column:
    return F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)


def html_text(page: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become a space, runs of white space too."""
    bare = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def html_links(page: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r'<a href="([^"]*)"'), F.lit(1))


def markdown(page: Column) -> Column:
    """A page as Markdown: headings, list items and paragraphs as lines, links kept, other markup gone."""
    out = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<head>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, f"(?i)<h{level}[^>]*>", "\n" + "#" * level + " ")
    out = F.regexp_replace(out, r'(?is)<a href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    out = F.regexp_replace(out, "(?i)<li[^>]*>", "\n- ")
    out = F.regexp_replace(out, "(?i)</?(p|div|article|nav|ul|ol|footer|h[1-6]|br)[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    return F.trim(F.regexp_replace(out, r"\n[ \t\n]*\n", "\n\n"))
