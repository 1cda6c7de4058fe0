"""Domain, invite and address detectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from modengine.config import ModerationConfig
from modengine.functions import fixed
from modengine.functions.normalize import collapse_repeats
from modengine.functions.words import is_common, strings


def ip_address(text: Column, config: ModerationConfig) -> Column:
    parts = [fixed.IP_DOTTED, *([fixed.IP_HEX] if config.ip_hex else []), *([fixed.IP_OBFUSCATED] if config.ip_obfuscated else [])]
    return text.rlike("|".join(parts))


def discord_invite(text: Column) -> Column:
    return text.rlike(fixed.DISCORD)


def invite_phrase(text: Column) -> Column:
    return text.rlike(fixed.INVITE)


def direct_hits(text: Column, tlds: Sequence[str]) -> Column:
    """Lower-case hits with explicit separators."""
    pattern = fixed.DIRECT_DOMAIN.format(tlds="|".join(dict.fromkeys(tlds)))
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)


def squished_hits(text: Column, tlds: Sequence[str]) -> Column:
    """Lower-case hits of a label directly followed by a domain of three letters or more."""
    longer = [t for t in dict.fromkeys(tlds) if len(t) >= 3]
    if not longer:
        return F.array().cast("array<string>")
    return F.transform(F.regexp_extract_all(text, F.lit(fixed.SQUISHED_DOMAIN.format(tlds="|".join(longer))), F.lit(0)), F.lower)


def _labels(hit: Column, tlds: Sequence[str]) -> Column:
    """What is left of a hit without each domain that it ends with."""
    ends = F.filter(strings(dict.fromkeys(tlds)), lambda t: (F.length(hit) > F.length(t)) & F.endswith(hit, t))
    return F.transform(ends, lambda t: F.left(hit, F.length(hit) - F.length(t)))


def _behind_single(hit: Column) -> Column:
    """The part behind the only separator of a hit, if that is not a dot; else empty."""
    others = F.length(hit) - F.length(F.translate(hit, ".,_-*", ""))
    return F.when((others == 1) & ~F.contains(hit, F.lit(".")), F.trim(F.regexp_extract(hit, r"(?s)[,_\-*](.*)$", 1))).otherwise(F.lit(""))


def domain_candidates(text: Column, tlds: Sequence[str]) -> Column:
    """Strings that the domain tests may look up in the dictionary."""
    squeezed = collapse_repeats(text)
    direct, squished = direct_hits(squeezed, tlds), squished_hits(squeezed, tlds)
    return F.array_distinct(F.concat(direct, F.transform(direct, _behind_single), squished, F.flatten(F.transform(squished, lambda h: _labels(h, tlds)))))


def domain(text: Column, common: Column, names: Column, config: ModerationConfig, tlds: Sequence[str]) -> Column:
    """names: lower-case variants of the names of present users, which are no domains."""
    squeezed = collapse_repeats(text)
    found = F.lit(False)
    if config.domain_discord:
        found = found | discord_invite(squeezed)
    if config.domain_invites:
        found = found | invite_phrase(squeezed)
    if config.domain_generic:
        known = lambda h: F.array_contains(names, h) | is_common(h, common)
        direct = lambda h: ~(known(h) | is_common(_behind_single(h), common))
        squished = lambda h: ~(known(h) | F.exists(_labels(h, tlds), known))
        found = found | F.exists(direct_hits(squeezed, tlds), direct) | F.exists(squished_hits(squeezed, tlds), squished)
    return found
