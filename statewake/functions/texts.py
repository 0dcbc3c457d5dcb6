"""Text functions: accents, identifiers, nested values, generics, derived query names, wording."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(texts: pd.Series) -> pd.Series:
    one = lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return texts.map(one)


def fold(text) -> Column:
    """NFKD without combining marks, in Arrow batches, since Spark has no built-in normalisation; null stays null."""
    return F.pandas_udf(_folded, "string")(text)


def identifier_parts(text: Column) -> Column:
    """The parts of identifiers joined by underscores, in order; they stand beside the tokens, not in their place."""
    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+"), F.lit(0)), lambda t: F.split(t, "_")))


def search_text(*values: Column) -> Column:
    """Values and the parts of their identifiers in one text."""
    whole = F.concat_ws(" ", *values)
    return F.trim(F.concat_ws(" ", whole, F.array_join(identifier_parts(whole), " ")))


def dig(payload: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where the path leads nowhere or the text is no JSON."""
    return F.get_json_object(payload, "$" + "".join(f"['{p}']" if not p.isdigit() else f"[{p}]" for p in path.split(".")))


def nested_fields(properties: Column, names: list[str]) -> Column:
    """Flat properties f_<name>_<key> as a map of maps by name; of several names that fit, the longest has the property."""
    order = sorted(names, key=lambda n: (-len(n), n))

    def owner(key: Column) -> Column:
        return F.coalesce(*(F.when(key.startswith(f"f_{n}_"), n) for n in order), F.lit(None).cast("string"))

    own = lambda n: F.transform_keys(F.map_filter(properties, lambda k, _: owner(k) == n), lambda k, _: F.substr(k, F.lit(len(n) + 4)))
    return F.map_filter(F.create_map(*(x for n in sorted(names) for x in (F.lit(n), own(n)))), lambda _, m: F.size(m) > 0)


def lucene_escape(text: Column) -> Column:
    """Text whose operators are plain characters for a Lucene query."""
    return F.regexp_replace(text, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1")


def unwrap_generic(name: Column) -> Column:
    """The innermost type of List<T>, Optional<List<T>> and the like, of maps the value; another name as it is."""
    inner = F.regexp_extract(F.regexp_replace(F.regexp_replace(name, r"\?\s*(extends|super)\s", ""), r"\s+", ""), r"([A-Za-z_][\w.]*)(?:\[\])*[>?]*$", 1)
    return F.when(name.contains("<") & (inner != ""), inner).otherwise(F.regexp_replace(F.trim(name), r"(\[\])+$", ""))


def type_names(expression: Column) -> Column:
    """Distinct names in an expression that begin with a capital, in order of appearance; qualified ones by their last part."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(r"(?<![\w])(?:[a-z_]\w*\.)*([A-Z]\w*)"), F.lit(1)))


# fixed values: endings of derived query predicates, longest first
OPERATORS = ("IsNotNull", "NotNull", "IsNull", "GreaterThanEqual", "GreaterThan", "LessThanEqual", "LessThan", "StartingWith", "EndingWith", "Containing", "Between", "NotIn", "NotLike", "Before", "After", "Like", "Not", "In", "True", "False")


def derived_predicates(method: Column) -> Column:
    """property:operator of each predicate of findByAAndBGreaterThan and the like, with Or before those that it joins; null for other names."""
    body = F.regexp_extract(method, r"^(?:find|read|get|query|count|exists|delete|remove)[A-Za-z0-9]*?By([A-Z]\w*?)(?:OrderBy[A-Z]\w*)?$", 1)
    marked = F.regexp_replace(F.regexp_replace(body, r"(?<=[a-z0-9])And(?=[A-Z])", " "), r"(?<=[a-z0-9])Or(?=[A-Z])", " |")
    ending = f"({'|'.join(OPERATORS)})$"

    def one(p: Column) -> Column:
        bare = F.regexp_replace(p, r"^\|", "")
        op = F.regexp_extract(bare, ending, 1)
        prop = F.when(op == "", bare).otherwise(F.substr(bare, F.lit(1), F.length(bare) - F.length(op)))
        return F.concat(F.when(p.startswith("|"), "Or ").otherwise(""), F.lower(F.substr(prop, F.lit(1), F.lit(1))), F.substr(prop, F.lit(2)), F.lit(":"), F.when(op == "", "Equals").otherwise(op))

    return F.when(body != "", F.transform(F.split(marked, " "), one))


# fixed values: guard atoms and how they read, tried in order
WORDING = (
    (r"^(\w+)\.isEmpty\(\)$", "no $1 exists"), (r"^(\w+)\.isPresent\(\)$", "$1 exists"), (r"^(\w+)\s*==\s*null$", "$1 is missing"), (r"^(\w+)\s*!=\s*null$", "$1 is given"), (r"^(\w+) is thrown$", "$1 happens"),
    (r"^(\w+)\s*>=\s*(.+)$", "$1 is at least $2"), (r"^(\w+)\s*<=\s*(.+)$", "$1 is at most $2"), (r"^(\w+)\s*>\s*(.+)$", "$1 is more than $2"), (r"^(\w+)\s*<\s*(.+)$", "$1 is less than $2"), (r"^(\w+)\s*==\s*(.+)$", "$1 is $2"),
)


def worded(atom: Column, negated: Column) -> Column:
    """A guard's atom in business language; underscores become spaces, and a negated one is told as not being so."""
    said = F.coalesce(*(F.when(atom.rlike(p), F.regexp_replace(atom, p, r)) for p, r in WORDING), atom)
    plain = F.replace(said, F.lit("_"), F.lit(" "))
    return F.when(negated, F.concat(F.lit("it is not so that "), plain)).otherwise(plain)


def drafted(source: Column, conditions: Column, trigger: Column, target: Column) -> Column:
    """A criterion for a transition: the last condition is the one under test, those before it are context. conditions: texts in order."""
    context = F.array_join(F.concat(F.array(F.concat(F.lit("the system is in "), source)), F.slice(conditions, 1, F.greatest(F.size(conditions) - 1, F.lit(0)))), " and ")
    last = F.when(F.size(conditions) > 0, F.concat(F.lit(" and "), F.element_at(conditions, -1))).otherwise("")
    return F.concat(F.lit("Given "), context, F.lit(", when "), trigger, last, F.lit(", then the system is in "), target)


def diagram_id(name: Column) -> Column:
    """A name as a diagram's identifier: letters, digits and underscores, never beginning with a digit."""
    safe = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9_]+", "_")
    return F.when(safe.rlike("^[0-9]") | (safe == ""), F.concat(F.lit("n_"), safe)).otherwise(safe)


def diagram_label(text: Column) -> Column:
    """A text as a diagram's label: one line, quotes as references."""
    return F.replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit('"'), F.lit("#quot;"))
