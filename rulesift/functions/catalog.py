"""Model price catalog: scalar functions (slug, tier, cost texts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulesift import fixed

# JavaScript String.prototype.trim: white space and line terminators.
JS_WHITESPACE = ("\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
                 "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(JS_WHITESPACE))


def js_number_text(m: Column) -> Column:
    """Number as JavaScript prints it for ordinary values (1 → "1", 0.33 → "0.33")."""
    whole = (m == F.floor(m)) & (F.abs(m) < 1e15)
    return F.when(whole, m.cast("long").cast("string")).otherwise(m.cast("string"))


def model_slug(name: Column) -> Column:
    """F8: lower case, no parentheses, white-space runs → '-', trimmed."""
    s = F.regexp_replace(F.lower(name), r"[()]", "")
    s = F.regexp_replace(s, r"(?U)\s+", "-")
    return js_trim(s)


def tier(m: Column) -> Column:
    """unavailable / base / low / standard / premium / expensive."""
    return (F.when(m.isNull(), "unavailable").when(m == 0, "base").when(m < 1, "low")
            .when(m <= 1, "standard").when(m <= 5, "premium").otherwise("expensive"))


def cost_label(m: Column) -> Column:
    """"Included" or "<m>× premium"."""
    return F.when(m == 0, "Included").otherwise(F.concat(js_number_text(m), F.lit("× premium")))


def overage(m: Column) -> Column:
    """price of one request above the plan, "$0.00" when included.
    Rounded half-up on the decimal value (documented difference on exact ties)."""
    return F.when(m == 0, "$0.00").otherwise(
        F.concat(F.lit("$"), F.format_string("%.2f", m * F.lit(fixed.OVERAGE_PER_REQUEST))))


def ui_cost_text(m: Column, free: Column) -> tuple[Column, Column]:
    """(label, badge) shown for a model."""
    label = F.when(m == 0, "Included with paid plans").otherwise(
        F.concat(js_number_text(m), F.lit("× premium request"), F.when(m != 1, "s").otherwise(""),
                 F.lit(" per use")))
    badge = F.when(m == 0, "No premium requests used").otherwise(
        F.when(free == 1, "1× on Free plan").otherwise(""))
    return label, badge


def option_text(name: Column, m: Column) -> Column:
    """text of one entry of the model chooser."""
    return F.concat(name, F.lit("    ·    "),
                    F.when(m == 0, "Included").otherwise(F.concat(js_number_text(m), F.lit("× premium"))))
