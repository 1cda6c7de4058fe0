"""The ordered rules: the first that blocks a message decides.

Cheap rules on the original text come first, then the stateful ones, then those on the normalized text. Each rule is a
predicate column and a message column; a stage is one ``coalesce`` over its rules, evaluated lazily row by row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modengine.config import ModerationConfig
from modengine.functions import domains, rules
from modengine.functions.fixed import TLDS
from modengine.functions.normalize import collapse_repeats, normalize
from modengine.functions.words import Lexicon, bad_message, candidates, obfuscated, strings, with_common_words
from modengine.operators.gates import bypass_flag
from modengine.operators.limits import limited


@dataclass(frozen=True)
class Rule:
    """``block`` maps (original, normalized, common words) to a predicate; ``message`` to the reply."""

    label: str
    block: Callable[[Column, Column, Column], Column]
    message: Callable[[Column, Column], Column]


@dataclass
class RuleSet:
    """An ordered list of rules; ``add`` returns the set, so calls chain."""

    rules: list[Rule] = field(default_factory=list)

    def add(self, label: str, block: Callable[[Column, Column, Column], Column], message: str | Callable[[Column, Column], Column], enabled: bool = True) -> RuleSet:
        if enabled:
            reply = message if callable(message) else (lambda original, normalized, m=message: F.lit(m))
            self.rules.append(Rule(label, block, reply))
        return self

    def decision(self, original: Column, normalized: Column, common: Column) -> Column:
        """struct(rule, block_message) of the first rule that blocks; null passes."""
        if not self.rules:
            return F.lit(None).cast("struct<rule:string,block_message:string>")
        return F.coalesce(*[F.when(r.block(original, normalized, common), F.struct(F.lit(r.label).alias("rule"), r.message(original, normalized).alias("block_message"))) for r in self.rules])


@dataclass(frozen=True)
class Moderator:
    """Everything that decides, except the tables. names: variants of present users' names; server_names: blocked names."""

    config: ModerationConfig = ModerationConfig()
    lexicon: Lexicon = Lexicon()
    server_names: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    tlds: tuple[str, ...] = TLDS
    scripts: tuple[str, ...] = rules.SCRIPTS

    def before(self) -> RuleSet:
        """Rules on the original text."""
        c = self.config
        return (
            RuleSet()
            .add("Illegal Characters", lambda o, n, k: rules.illegal_characters(o, c.allowed_blocks), c.whitelist_message, c.whitelist_enabled)
            .add("MiniMessage", lambda o, n, k: rules.formatting_tag(o), c.tags_message, c.tags_enabled)
            .add("Color Code", lambda o, n, k: rules.color_code(o), c.colors_message, c.colors_enabled)
            .add("Message Too Long", lambda o, n, k: rules.too_long(o, c.max_length), c.length_message.replace("%max%", str(c.max_length)), c.length_enabled)
            .add("Repeated Character Spam", lambda o, n, k: rules.repeated_character(o, c.max_repeats), c.repeats_message, c.repeats_enabled)
            .add("IP", lambda o, n, k: domains.ip_address(o, c), c.ip_message, c.ip_enabled)
        )

    def after(self) -> RuleSet:
        """Rules on both or the normalized text."""
        c, names = self.config, strings(self.names)
        site = lambda text, k: domains.domain(text, k, names, c, self.tlds)
        word = lambda text, k: bad_message(text, k, self.lexicon) | obfuscated(text, k, self.lexicon)
        made = (
            RuleSet()
            .add("Domain", lambda o, n, k: site(o, k) | site(n, k), c.domain_message, c.domain_enabled)
            .add("Swear", lambda o, n, k: word(collapse_repeats(n), k), c.words_message, c.words_enabled and bool(self.lexicon.fuzzy or self.lexicon.basic))
            .add("Server Name", lambda o, n, k: rules.server_name(n, self.server_names).isNotNull(), lambda o, n: F.replace(F.lit(c.server_name_message), F.lit("%name%"), rules.server_name(n, self.server_names)), bool(self.server_names))
        )
        for custom in c.custom_rules:
            made.add(f"Custom: {custom.name}", lambda o, n, k, p=custom.pattern: rules.custom_pattern(n, p), custom.block_message, custom.enabled)
        return made.add("Mixed Script", lambda o, n, k: rules.mixed_script(n, self.scripts), c.mixed_message, c.mixed_enabled)

    def lookups(self, original: Column, normalized: Column) -> Column:
        """The strings of a message that its rules may look up in the dictionary."""
        found = []
        if self.config.domain_enabled and self.config.domain_generic:
            found += [domains.domain_candidates(t, self.tlds) for t in (original, normalized)]
        if self.config.words_enabled and (self.lexicon.fuzzy or self.lexicon.basic):
            found.append(candidates(collapse_repeats(normalized), self.lexicon))
        return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")

    def decide(self, messages: DataFrame, dictionary: DataFrame | None = None, exempt: DataFrame | None = None) -> DataFrame:
        """``messages`` (msg_id unique, ts, user_id, text) with normalized, bypassed, blocked, rule and block_message.

        Null text passes; a message without a user is checked but never limited; exempt users pass unchecked. The
        stateful rules see only the messages that pass all rules before them.
        """
        c, text = self.config, F.col("text")
        rows = messages.withColumn("bypassed", F.lit(False)) if exempt is None else bypass_flag(messages, exempt)
        rows = rows.withColumn("normalized", normalize(text))
        none = F.array().cast("array<string>")
        rows = rows.withColumn("pre", F.when(~F.col("bypassed"), self.before().decision(text, F.col("normalized"), none)))
        if c.rate_enabled or c.flood_enabled:
            rows = self._limited(rows)
        if dictionary is None:
            rows = rows.withColumn("common", none)
        else:
            open_ = F.col("pre").isNull() & ~F.col("bypassed")
            rows = with_common_words(rows, F.when(open_, self.lookups(text, F.col("normalized"))), dictionary, "msg_id")
        post = F.when(~F.col("bypassed"), self.after().decision(text, F.col("normalized"), F.col("common")))
        rows = rows.withColumn("decision", F.coalesce(F.col("pre"), post))
        return rows.select(*messages.columns, "normalized", "bypassed", F.col("decision").isNotNull().alias("blocked"), "decision.rule", "decision.block_message")

    def _limited(self, rows: DataFrame) -> DataFrame:
        """Both stateful rules over the messages that reach them; the others do not move."""
        c = self.config
        reach = F.col("pre").isNull() & ~F.col("bypassed") & F.col("user_id").isNotNull()
        found = limited(rows.filter(reach), (c.rate_max, c.rate_seconds) if c.rate_enabled else None, (c.flood_seconds, c.flood_similarity, c.flood_max) if c.flood_enabled else None)
        outcome = lambda label, message: F.struct(F.lit(label).alias("rule"), F.lit(message).alias("block_message"))
        pre = F.when(F.col("limit") == "rate", outcome("Rate Limit", c.rate_message)).when(F.col("limit") == "flood", outcome("Flood", c.flood_message))
        return found.withColumn("pre", pre).drop("limit").unionByName(rows.filter(~reach))


def dry_run(moderator: Moderator, texts: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Decisions for texts (msg_id, text) that no user sent: no exemption, no limits, and no violation later."""
    rows = texts.select("msg_id", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("user_id"), "text")
    return moderator.decide(rows, dictionary)
