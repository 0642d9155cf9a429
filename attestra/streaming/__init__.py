"""The batch matcher over arriving documents."""
