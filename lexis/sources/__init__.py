"""Where lexicon tables come from."""
