"""Message-passing layers as plans over relation tables."""
