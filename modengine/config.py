"""Configuration of the rules, with defaults, loading from nested mappings, and warnings."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from pyspark.errors import IllegalArgumentException

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class CustomRule:
    """A named pattern (Java syntax) that blocks the messages it is found in."""

    name: str
    pattern: str
    block_message: str = "&cThat message is not allowed."
    enabled: bool = True


_ENGLISH_ONLY = "&cPlease use only standard English characters."
_NO_FORMATTING = "&cPlease don't use chat formatting codes."


@dataclass(frozen=True)
class ModerationConfig:
    whitelist_enabled: bool = True
    allowed_blocks: tuple[str, ...] = ("BASIC_LATIN", "GENERAL_PUNCTUATION")
    whitelist_message: str = _ENGLISH_ONLY
    length_enabled: bool = True
    max_length: int = 25
    length_message: str = "&cYour message is too long. Keep it under %max% characters."
    ip_enabled: bool = True
    ip_hex: bool = True
    ip_obfuscated: bool = True
    ip_message: str = "&cAdvertising IP addresses is not allowed."
    domain_enabled: bool = True
    domain_generic: bool = True
    domain_discord: bool = True
    domain_invites: bool = True
    domain_message: str = "&cAdvertising servers or domains is not allowed."
    words_enabled: bool = True
    words_message: str = "&cPlease keep chat respectful."
    repeats_enabled: bool = True
    max_repeats: int = 5
    repeats_message: str = "&cdon't spam characters."
    server_name_message: str = "&cPlease don't say other servers name (%name%)"
    rate_enabled: bool = False
    rate_max: int = 5
    rate_seconds: int = 10
    rate_message: str = "&cYou're chatting too fast."
    flood_enabled: bool = False
    flood_similarity: float = 0.85
    flood_seconds: int = 30
    flood_max: int = 2
    flood_message: str = "&cPlease don't repeat messages."
    custom_rules: tuple[CustomRule, ...] = ()
    mixed_enabled: bool = False
    mixed_message: str = _ENGLISH_ONLY
    tags_enabled: bool = True
    tags_message: str = _NO_FORMATTING
    colors_enabled: bool = True
    colors_message: str = _NO_FORMATTING
    bypass_ops: bool = False
    audit_enabled: bool = False

    def problems(self) -> list[str]:
        """Values that make no sense; they are reported, not corrected."""
        found = []
        if self.length_enabled and self.max_length <= 0:
            found.append(f"max_length must be > 0, got {self.max_length}")
        if self.repeats_enabled and self.max_repeats <= 0:
            found.append(f"max_repeats must be > 0, got {self.max_repeats}")
        if self.rate_enabled and (self.rate_max <= 0 or self.rate_seconds <= 0):
            found.append("rate limit values must be > 0")
        return found


#: Paths of the settings in a nested configuration document.
PATHS = {
    "character_whitelist": {"enabled": "whitelist_enabled", "allowed_unicode_blocks": "allowed_blocks", "block_message": "whitelist_message"},
    "max_message_length": {"enabled": "length_enabled", "max_length": "max_length", "block_message": "length_message"},
    "ip_detection": {"enabled": "ip_enabled", "block_hex_ip": "ip_hex", "block_obfuscated": "ip_obfuscated", "block_message": "ip_message"},
    "domain_detection": {"enabled": "domain_enabled", "block_generic": "domain_generic", "block_discord": "domain_discord", "block_invite_phrases": "domain_invites", "block_message": "domain_message"},
    "swear_detection": {"enabled": "words_enabled", "block_message": "words_message"},
    "repeated_char_spam": {"enabled": "repeats_enabled", "max_repeats": "max_repeats", "block_message": "repeats_message"},
    "bypass": {"ops": "bypass_ops"},
    "rate_limit": {"enabled": "rate_enabled", "max_messages": "rate_max", "window_seconds": "rate_seconds", "block_message": "rate_message"},
    "flood_detection": {"enabled": "flood_enabled", "similarity_threshold": "flood_similarity", "window_seconds": "flood_seconds", "max_repeats": "flood_max", "block_message": "flood_message"},
    "mixed_script_detection": {"enabled": "mixed_enabled", "block_message": "mixed_message"},
    "minimessage_filter": {"enabled": "tags_enabled", "block_message": "tags_message"},
    "color_code_filter": {"enabled": "colors_enabled", "block_message": "colors_message"},
    "audit_log": {"enabled": "audit_enabled"},
}


def custom_rules(raw: list[Mapping[str, Any]] | None, valid=lambda pattern: True) -> tuple[CustomRule, ...]:
    """Rules of a list of mappings; one without a pattern is left out, one with a bad pattern too, with a warning."""
    made = []
    for section in raw or ():
        rule = CustomRule(section.get("name", "rule"), section.get("pattern") or "", section.get("block_message", CustomRule.block_message), section.get("enabled", True))
        if not section.get("pattern"):
            continue
        if valid(rule.pattern):
            made.append(rule)
        else:
            log.warning("Invalid regex rule '%s': %s", rule.name, rule.pattern)
    return tuple(made)


def load_config(document: Mapping[str, Any], valid=lambda pattern: True) -> ModerationConfig:
    """A configuration from a nested mapping; values of the wrong type and missing ones keep their defaults."""
    defaults, values = ModerationConfig(), {}
    kinds = {f.name: type(getattr(defaults, f.name)) for f in fields(ModerationConfig)}
    for section, names in PATHS.items():
        given = document.get(section) or {}
        for key, name in names.items():
            if key not in given:
                continue
            value, kind = given[key], kinds[name]
            if kind is tuple and isinstance(value, (list, tuple)):
                values[name] = tuple(str(v) for v in value)
            elif kind is float and isinstance(value, (int, float)) and not isinstance(value, bool):
                values[name] = float(value)
            elif isinstance(value, kind) and not (kind is int and isinstance(value, bool)):
                values[name] = value
    if isinstance(document.get("server_name_block_message"), str):
        values["server_name_message"] = document["server_name_block_message"]
    values["custom_rules"] = custom_rules(document.get("custom_rules"), valid)
    config = ModerationConfig(**values)
    for problem in config.problems():
        log.warning(problem)
    return config


def java_regex_check(spark):
    """A check of patterns by the JVM's own compiler, for ``custom_rules``."""

    def valid(pattern: str) -> bool:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException:  # a syntax error is one
            return False
        return True

    return valid
