"""veilframe: find, redact, pseudonymise and audit personal data on Spark."""

from veilframe.functions.rules import Rule, default_rules, register_rule, unregister_rule
from veilframe.operators.gazetteer import Gazetteer
from veilframe.operators.mapping import derive_key
from veilframe.plans.scrub import Scrubbed, scrub

__all__ = ["Gazetteer", "Rule", "Scrubbed", "default_rules", "derive_key", "register_rule", "scrub",
           "unregister_rule"]
