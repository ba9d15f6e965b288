"""Plan building blocks: joins that survive hot keys, as-of state, work folder."""
