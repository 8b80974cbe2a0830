"""Part of pixelloom."""
