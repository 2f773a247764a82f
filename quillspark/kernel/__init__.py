"""The grammar: one page of wikitext to a tree of nodes, in plain Python."""
