"""Parameters for the driver tables: their prose is invented, so it brings its own entities and rules."""

from __future__ import annotations

from factloom.operators.entities import EntityDictionary
from factloom.operators.rules import RuleSet

# Entities of the test tables, by tokens their prose has; rules on the same words.
ENTITIES = """
Eriner | Company | Eriner; Eriner thanea; Thanedble
Nicht | Company | Nicht; Nicht die
Thon | Company | Thon; Thon the
Enmentai | Company | Enmentai
License | Policy | License; MIT License; Apache License
Licensed | Policy | Licensed; Licensed under
Apache | Organization | Apache; Apache License
Version 2.0 | Concept | Version 2.0; Version
Anon | Person | Anon; Mr. Anon
Ther | Person | Ther
Than | Region | Than; that than
De La | Region | de la; de las
Von Der | Region | von der; von den
Retion | Concept | Retion; Ertion
Thly | Concept | Thly
Market share | Concept | Ofonrereer; rere
Inner | Concept | tion of
Signs | Concept | ###; $$$ ; +
Thea Erre Trust | Company | Thea Erre Trust
Thnt Thor Alliance | Company | Thnt Thor Alliance
Thed Ther Region | Region | Thed Ther Region
Estion Tionth Board | Organization | Estion Tionth Board
Thre Onst Union | Policy | Thre Onst Union
"""
UNBOUNDED = ("tion of", "###")
GENERIC = ("Thly", "Market share", "Than", "Inner")
NOT_SPECIFIC = ("Market share", "Thly")
SUBJECT_RULES = """
DELIVERED | deliveries | the
REPORTED_REVENUE | revenue | ing, tion
SALES_INCREASED | sales growth/change | and & er, up
"""
FIXED_RULES = """
License | SUBSIDIARY_OF | Apache | license & apache |
Anon | FOUNDER_OF | Eriner | anon & the, of |
License | ASSOCIATED_WITH | metric:License share: 2.0 | license | 2.0
Than | SURPASSED | Ther | than & ther | Th
"""
FAN_RULES = """
Licensed | RELATED_TO | licensed under, eriner
"""

DICTIONARY = EntityDictionary.from_table(ENTITIES, UNBOUNDED)
RULES = RuleSet.from_tables(SUBJECT_RULES, FIXED_RULES, FAN_RULES)
