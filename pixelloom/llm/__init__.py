"""Operators that prepare large text corpora for training. Nothing else in pixelloom imports this subpackage."""
