"""These must equal the moderated protocol's own for right results."""

from __future__ import annotations

# An ASCII word boundary, as \b is defined on current JVMs; the \b of older ones is Unicode-aware.
B = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# Code points removed first.
ZERO_WIDTH = (
    r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}"
    r"\x{205F}-\x{2064}\x{2066}-\x{2069}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E007F}"
)

# Look-alike letters and their Latin counterparts.
CYRILLIC, CYRILLIC_AS = "аеіјорсѕхуһԁԛԝӏг", "aeijopcsxyhdqwlr"
GREEK, GREEK_AS = "αοεκνρστχ", "aoekvpctx"

# Multi-character leet, in order of precedence, and single-character leet.
LEET = (("|_|", "u"), ("|3", "b"), ("|2", "r"), ("|\\/|", "m"), ("\\/\\/", "w"), ("\\/", "v"), ("'/", "y"), ("><", "x"), ("ph", "f"))
LEET_CHARS, LEET_AS = "@431!0$57+8692", "aaeiiossttbggz"

# Separator patterns, in the order of their steps.
DOT_VARIANTS = r"(?i)\(\s*d[o0]t\s*\)|\[dot]| dot "
DOTS_BETWEEN_LETTERS = r"(?<=\p{L})\.+(?=\p{L})"
REPEATED_PUNCTUATION = r"([^a-zA-Z0-9])\1+"
SEPARATOR_CLEANUP = r"\s*([*_\-|])(?!\s)"
BRACKET_CLEANUP = r"(?<=\p{L})[()\[\]{}]+(?=\p{L})"
INLINE_PUNCTUATION = r"(?<=\p{L})[*_'\-|](?=\p{L})"

# Allowed character blocks by name.
BLOCKS = {
    "BASIC_LATIN": (0x0000, 0x007F),
    "LATIN_1_SUPPLEMENT": (0x0080, 0x00FF),
    "LATIN_EXTENDED_A": (0x0100, 0x017F),
    "GENERAL_PUNCTUATION": (0x2000, 0x206F),
    "CURRENCY_SYMBOLS": (0x20A0, 0x20CF),
}

# Message patterns.
TAG = r"(?i)<[/]?[a-z][a-z0-9_]*(?::[^>]*)?>"
COLOR_CODE = r"(?i)[&Â§](?:[0-9a-fk-or]|x(?:[&Â§][0-9a-f]){6})"
IP_DOTTED = rf"{B}(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{B}"
IP_HEX = r"0x[0-9a-fA-F]{1,2}(?:\.[0-9a-fA-F]{1,2}){3}"
IP_OBFUSCATED = rf"{B}\d{{1,3}}\s*[,;:]\s*\d{{1,3}}\s*[,;:]\s*\d{{1,3}}\s*[,;:]\s*\d{{1,3}}{B}"
PRIVATE_MESSAGE = r"(?i)\A/(?:msg|tell|w|whisper|reply|r)\s+(\S+)\s+(.*)\z"

# Domain patterns; {tlds} is an alternation in the order of the list.
SEPARATORS = r"\.|\(dot\)|\[dot]|dot|,|-|_|\*"
DIRECT_DOMAIN = rf"(?i){B}(?:[a-z0-9-]+\s*(?:{SEPARATORS})\s*)+(?:{{tlds}})(?:\s*:\s*\d{{{{1,5}}}})?{B}"
SQUISHED_DOMAIN = rf"(?i){B}[a-z0-9-]{{{{3,}}}}(?:{{tlds}}){B}"
DISCORD = rf"(?i)discord\s*(?:{SEPARATORS}|\s)+(?:gg/\w+|com/invite/\w+)"
# The third phrase is \bjoin\s+\w+(?:\s*,?\s*\w+)+[,.:]\s*\d{3,5}, written without nested repetition: it stops at the first
# place where the number follows, so long texts need neither backtracking nor stack.
INVITE = rf"(?i)(?:join\s+(?:my\s+)?server|{B}ip:\s*[a-z0-9.\s]+|{B}join\s+\w\s*+,?\s*+\w(?:(?![,.:]\s*\d{{3}})\s*+,?\s*+\w)*+[,.:]\s*\d{{3,5}})"

# Two-letter words that are always common.
TWO_LETTER_WORDS = ("am", "an", "as", "at", "be", "by", "do", "go", "he", "hi", "if", "in", "is", "it", "my", "no", "of", "oh", "ok", "on", "or", "so", "to", "up", "us", "we", "ye")

#: A default list of top-level domains; the full list of a deployment is a parameter.
TLDS = ("com", "net", "org", "io", "gg", "xyz", "me", "tv", "to", "co", "info", "online", "site", "store", "club", "live", "dev", "app", "ai", "shop")
