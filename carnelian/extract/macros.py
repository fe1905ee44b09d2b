"""Class macros and the methods that they make, as a table that callers may add to."""

from __future__ import annotations

import re

#: Macro, template of a made name ({} the argument, {1} its singular), class side, parameters, whether it returns the named class.
TABLE: list[tuple[str, str, bool, int, str]] = [
    ("belongs_to", "{}", False, 0, "one"), ("belongs_to", "{}=", False, 1, ""), ("belongs_to", "build_{}", False, -1, "one"),
    ("belongs_to", "create_{}", False, -1, "one"), ("belongs_to", "create_{}!", False, -1, "one"), ("belongs_to", "reload_{}", False, 0, "one"), ("belongs_to", "reset_{}", False, 0, ""),
    ("has_one", "{}", False, 0, "one"), ("has_one", "{}=", False, 1, ""), ("has_one", "build_{}", False, -1, "one"),
    ("has_one", "create_{}", False, -1, "one"), ("has_one", "create_{}!", False, -1, "one"), ("has_one", "reload_{}", False, 0, "one"), ("has_one", "reset_{}", False, 0, ""),
    ("has_many", "{}", False, 0, ""), ("has_many", "{}=", False, 1, ""), ("has_many", "{1}_ids", False, 0, ""), ("has_many", "{1}_ids=", False, 1, ""),
    ("has_and_belongs_to_many", "{}", False, 0, ""), ("has_and_belongs_to_many", "{}=", False, 1, ""), ("has_and_belongs_to_many", "{1}_ids", False, 0, ""), ("has_and_belongs_to_many", "{1}_ids=", False, 1, ""),
    ("has_one_attached", "{}", False, 0, ""), ("has_one_attached", "{}=", False, 1, ""), ("has_many_attached", "{}", False, 0, ""), ("has_many_attached", "{}=", False, 1, ""),
    ("accepts_nested_attributes_for", "{}_attributes=", False, 1, ""), ("scope", "{}", True, -1, ""),
    ("has_secure_password", "{}=", False, 1, ""), ("has_secure_password", "{}_confirmation=", False, 1, ""), ("has_secure_password", "authenticate_{}", False, 1, ""),
    ("has_secure_token", "regenerate_{}", False, 0, ""), ("attribute", "{}", False, 0, ""), ("attribute", "{}=", False, 1, ""), ("attribute", "{}?", False, 0, ""),
    ("define_model_callbacks", "before_{}", True, -1, ""), ("define_model_callbacks", "around_{}", True, -1, ""), ("define_model_callbacks", "after_{}", True, -1, ""),
    ("class_attribute", "{}", True, 0, ""), ("class_attribute", "{}=", True, 1, ""), ("class_attribute", "{}?", True, 0, ""),
    ("class_attribute", "{}", False, 0, ""), ("class_attribute", "{}=", False, 1, ""), ("class_attribute", "{}?", False, 0, ""),
    *[(f"{p}_{k}", t, side, n, "") for p in ("mattr", "cattr", "thread_mattr", "thread_cattr") for side in (True, False) for k, t, n in (("reader", "{}", 0), ("writer", "{}=", 1), ("accessor", "{}", 0), ("accessor", "{}=", 1))],
    ("attr_reader", "{}", False, 0, ""), ("attr", "{}", False, 0, ""), ("attr_writer", "{}=", False, 1, ""), ("attr_accessor", "{}", False, 0, ""), ("attr_accessor", "{}=", False, 1, ""),
    ("store_accessor", "{}", False, 0, ""), ("store_accessor", "{}=", False, 1, ""),
]
#: What dirty tracking adds for an attribute.
DIRTY = ("{}_changed?", "{}_was", "{}_previously_changed?", "{}_before_last_save", "saved_change_to_{}?", "will_save_change_to_{}?")
#: Macros whose every symbol argument is a name; of others only the first is.
MANY = {"attr_reader", "attr_writer", "attr_accessor", "attr", "class_attribute", "define_model_callbacks", "accepts_nested_attributes_for", "store_accessor"} | {f"{p}_{k}" for p in ("mattr", "cattr", "thread_mattr", "thread_cattr") for k in ("reader", "writer", "accessor")}
NAMES = {m for m, *_ in TABLE}
#: Symbols given to these are names of methods that they call.
BY_NAME = {"send", "public_send", "__send__", "try", "try!", "method", "public_method"}
MIXINS = {"include", "prepend", "extend"}


def singular(word: str) -> str:
    """The singular by the rules of functions.scalars, in Python for extraction."""
    from carnelian.functions.scalars import IRREGULAR, SINGULARS, UNCOUNTABLE

    if any(re.search(rf"(?:^|_|\b){w}$", word) for w in UNCOUNTABLE):
        return word
    for one, many in IRREGULAR:
        if word.endswith(many):
            return word[: -len(many)] + one
    for pattern, into in SINGULARS:
        if re.search(pattern, word):
            return re.sub(pattern, lambda m, into=into: re.sub(r"\$(\d)", lambda g: m.group(int(g[1])) or "", into), word, count=1)
    return word


def camelize(word: str) -> str:
    return "::".join("".join(w[:1].upper() + w[1:] for w in part.split("_")) for part in word.split("/"))


def associated_class(macro: str, name: str, class_name: str | None) -> str | None:
    """The class that an association names."""
    if class_name:
        return class_name
    if macro in ("belongs_to", "has_one"):
        return camelize(name)
    return camelize(singular(name)) if macro in ("has_many", "has_and_belongs_to_many") else None


def made(macro: str, name: str, class_name: str | None = None, table: list | None = None) -> list[tuple[str, bool, int, str | None]]:
    """(name, class side, parameters or -1 for any, returned class) of the methods that macro :name makes."""
    one = associated_class(macro, name, class_name)
    return [(template.replace("{1}", singular(name)).replace("{}", name), side, n, one if returns == "one" else None) for m, template, side, n, returns in (table or TABLE) if m == macro]
