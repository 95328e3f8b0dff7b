"""DataFrame operators: batching, masks, blocks, placement, schedules, attention, experiments, allocation."""
