"""Operators for training data of language models: packing, mixing and splitting of texts. Nothing else in the library imports this."""
