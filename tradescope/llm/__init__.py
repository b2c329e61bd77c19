"""Training-data operators: tokens, language, chat, packing, near copies, toxicity, search.

Nothing else in the library imports this subpackage.
"""
