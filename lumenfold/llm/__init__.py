"""Training-data operators for language-model corpora.  Nothing outside this folder imports it."""
