"""foliant: a PySpark-native document analytics engine.

Documents are tables here: text becomes lines, lines become typed blocks, and
blocks become scores, roll-ups and facts, all as DataFrame plans that Catalyst
optimises.
"""
