"""Element sets, word lists and codes that define the semantics."""

from __future__ import annotations

VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCK = (
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd",
    "caption", "figcaption", "blockquote", "title", "div", "table", "tr",
    "thead", "tbody", "tfoot", "colgroup", "ol", "ul", "nav", "section",
    "article", "header", "footer", "body", "head", "hr",
)
#: Boundaries of units besides BLOCK, and blocks that are copied verbatim.
EXTRA_BLOCKS = ("pre", "style", "script", "dl", "svg", "image", "math", "figure")
LITERAL_BLOCKS = ("pre", "style", "script", "svg", "image", "math")
OPAQUE_INLINE = ("code", "tt", "kbd", "samp", "var")
PROSE_BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "caption", "figcaption", "blockquote", "title")
LANG_ATTRS = ("lang", "xml:lang")
QUOTED_TAGS = ("i", "em", "cite", "code", "kbd", "samp")
FUNCTION_WORDS = {
    "english": (
        "quite", "moreover", "however", "doubtless", "thereby", "whereas",
        "indeed", "therefore", "furthermore", "nevertheless", "besides",
        "although", "though", "whereby", "henceforth", "hitherto",
        "notwithstanding", "envisaged", "insofar", "likewise", "namely",
    ),
    "french": ("toutefois", "néanmoins", "cependant", "d'ailleurs", "ainsi", "désormais", "notamment", "sans doute", "en effet"),
}
LANG_CODES = {
    "english": "en", "italian": "it", "french": "fr", "german": "de",
    "spanish": "es", "portuguese": "pt", "bulgarian": "bg", "dutch": "nl",
    "swedish": "sv", "norwegian": "no", "danish": "da", "finnish": "fi",
    "polish": "pl", "czech": "cs", "slovak": "sk", "hungarian": "hu",
    "romanian": "ro", "greek": "el", "turkish": "tr", "russian": "ru",
    "ukrainian": "uk", "serbian": "sr", "croatian": "hr", "slovenian": "sl",
    "catalan": "ca", "galician": "gl", "basque": "eu", "latin": "la",
    "arabic": "ar", "hebrew": "he", "persian": "fa", "hindi": "hi",
    "chinese": "zh", "japanese": "ja", "korean": "ko", "vietnamese": "vi",
    "thai": "th", "indonesian": "id", "malay": "ms", "esperanto": "eo",
}
DEFAULTS = {
    "model": "", "base_url": "http://localhost:11434/v1",
    "source_lang": "english", "target_lang": "italian", "dest_code": "it", "register": "tu",
    "truncation_ratio": 0.5, "pagebreak_re": 'epub:type="pagebreak"', "code_class_hints": [],
    "block_text_ratio": 0.7, "block_text_min": 80, "check_max_chars": 150000,
    "batch_chars": 16000, "unit_retries": 2, "block_retries": 2, "progress": "percent",
    "retries": 3, "backoff_s": 5, "library": "", "source_epub": "",
}
MAX_BATCH_UNITS = 40
# The spellings in which placeholders, answers, notes and earlier
# outcomes are written, and the reasons that outcomes carry.
MARKER = r"<\s*(/?)\s*([gx])(\d+)\s*(/?)\s*>"
TAG_LIKE = r"</?[A-Za-z][^<>]*>"
FENCE = r"(?m)^\s*```[a-zA-Z]*\s*$"
ELLIPSIS = r"…|\.(?:\s*\.){2,}"
INSTEAD = r"""(?i)["«“]([^"»”\n]{1,40})["»”]\s*(?:invece di|instead of)\s*["«“]([^"»”\n]{1,40})["»”]"""
TYPO_SHARE, TYPO_HITS, TWIN_DISTANCE = 0.34, 3, 2
REASONS = {
    "missing": "placeholder {} missing",
    "repeated": "placeholder {} repeated — keep each exactly once, in the original order",
    "order": "placeholders out of their original order",
    "markup": "markup in the answer: {}",
    "short": "text abbreviated: {} of {} chars ({}%)",
    "ellipsis": "an ellipsis was added — text likely omitted",
    "term": "term '{}' not rendered as '{}'",
    "absent": "the segment was missing from the answer",
    "gave up": "gave up after {} attempts ({})",
    "twin": "the previous output wrote “{}”, which is the rendering of “{}” — a DIFFERENT term. Never use it for “{}”.",
    "near": "the previous output wrote “{}” instead — it is not the required form.",
}
