"""Text functions that need Python: folding, transliteration, cosmetic names, HTML; vectorised and registered for SQL."""

from __future__ import annotations

import re
import unicodedata
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Cyrillic and Greek letters with their Latin spelling.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    "і": "i", "ї": "yi", "є": "ye", "ґ": "g", "ў": "u", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz",
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
    "ά": "a", "έ": "e", "ή": "i", "ί": "i", "ό": "o", "ύ": "y", "ώ": "o", "ϊ": "i", "ϋ": "y", "ΐ": "i", "ΰ": "y",
}
#: Tags and attributes that clean HTML may keep.
TAGS = frozenset("p br b i em strong u s ul ol li blockquote h1 h2 h3 h4 h5 h6 a span div hr sub sup".split())
ATTRIBUTES = {"a": {"href", "title"}, "span": {"style"}, "p": {"style"}, "div": {"style"}}
STYLES = frozenset(("text-align", "font-weight", "font-style", "text-decoration"))


def fold(s: str | None) -> str | None:
    """Lower case without diacritics."""
    return None if s is None else "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


def transliterate(s: str | None) -> str | None:
    """Latin letters, each word with a capital, for Cyrillic and Greek; other text as it is."""
    if s is None or not re.search(r"[Ͱ-ϿЀ-ԯἀ-῿]", s):
        return s
    return re.sub(r"\S+", lambda m: m[0][0].upper() + m[0][1:], "".join(LATIN.get(c.lower(), c) for c in s))


def cosmetic(name: str | None) -> str | None:
    """A file name's letters and digits alone, without copy marks and edition notes."""
    if name is None:
        return None
    s = unicodedata.normalize("NFKD", re.sub(r"\.[A-Za-z0-9]{2,4}$", "", name))
    s = "".join(c for c in s if unicodedata.category(c) not in ("Cf", "Mn"))
    s = re.sub(r"\(\d{1,2}\)|\[[^\]]*\]|\b(?:retail|scan|ocr|v\d(?:\.\d)?)\b", " ", s.lower())
    return re.sub(r"[^a-z0-9?]+", "", s)


def same_work(a: str | None, b: str | None) -> bool:
    """Equal, or of one length with at most a quarter of the places unreadable (``?``) on one side."""
    if not a or not b or len(a) != len(b):
        return False
    joker = sum(x != y and "?" in (x, y) for x, y in zip(a, b, strict=True))
    return all(x == y or "?" in (x, y) for x, y in zip(a, b, strict=True)) and joker <= 0.25 * len(a)


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in TAGS and not self.skip:
            kept = []
            for k, v in attrs:
                v = v or ""
                if k == "style":
                    v = "; ".join(x.strip() for x in v.split(";") if x.split(":")[0].strip().lower() in STYLES and "url" not in x.lower())
                if k in ATTRIBUTES.get(tag, ()) and v and not re.match(r"\s*(?:javascript|data|vbscript):", v, re.I):
                    kept.append(f' {k}="{escape(v)}"')
            self.out.append(f"<{tag}{''.join(kept)}>")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in TAGS and tag not in ("br", "hr") and not self.skip:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(escape(data, quote=False))


def clean_html(s: str | None) -> str | None:
    if s is None:
        return None
    c = _Cleaner()
    c.feed(s)
    c.close()
    return "".join(c.out)


def _text(f):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


fold_udf, transliterate_udf, cosmetic_udf, clean_html_udf = map(_text, (fold, transliterate, cosmetic, clean_html))


@F.pandas_udf(BooleanType())
def same_work_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_work(x, y) for x, y in zip(a, b, strict=True)])


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    for name, f in {"fold_accents": fold_udf, "transliterate": transliterate_udf, "cosmetic_name": cosmetic_udf, "clean_html": clean_html_udf, "same_work": same_work_udf}.items():
        spark.udf.register(name, f)
